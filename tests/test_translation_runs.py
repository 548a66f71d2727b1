"""Translations over several runs, and calls in flight."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from quirework.operators import asking, translate, translation_cache
from quirework.sources import scratch

PARAGRAPHS = "doc_id long, id string, text string, category string"


class Logged:
    """Writes each text that it is asked for to a file, and fails as told."""

    name, max_text_length, concurrency, batch_size = "logged", None, 2, 2

    def __init__(self, folder, kill=0, fail="", error=translate.ConfigurationError):
        self.folder, self.kill, self.fail, self.error = folder, kill, fail, error

    def translate_batch(self, texts, source, target):
        if self.kill and not os.path.exists(f"{self.folder}/killed") and os.path.exists(f"{self.folder}/asked") and len(asked(self.folder)) >= self.kill:
            open(f"{self.folder}/killed", "w").close()
            os._exit(1)
        if self.fail and self.fail in texts:
            raise self.error("told to")
        for t in texts:
            with open(f"{self.folder}/asked", "a") as f:
                f.write(t + "\n")
        return [t.upper() for t in texts]


def asked(folder):
    with open(f"{folder}/asked") as f:
        return sorted(f.read().split())


def rows(spark, n, each=1):
    return spark.createDataFrame([(i, f"p{i}", f"t{i // each:03d}", "text") for i in range(n)] + [(900, "x", "title", "doc_title"), (901, "y", None, "text")], PARAGRAPHS)


def test_a_killed_run_goes_on(spark, tmp_path):
    """A worker dies in the middle of a run; the next run asks for no text a second time."""
    folder = tmp_path / "log"
    folder.mkdir()
    cache = translation_cache.TranslationCache(spark, f"{tmp_path}/cache")
    p = rows(spark, 120, 2)
    with pytest.raises(Exception):
        translation_cache.translate_cached(p, Logged(str(folder), kill=20), "en", "de", cache, "1", size=2)
    time.sleep(1)  # other tasks end
    assert 0 < len(asked(folder)) < 60
    key = translation_cache.text_key("logged", "en", "de", F.col("text")).alias("key")
    kept = {r.text for r in p.select(key, "text").join(cache.answers(), "key").collect()}
    out = translation_cache.translate_cached(p, Logged(str(folder)), "en", "de", cache, "2", size=2).collect()
    # what was under way (four tasks of four texts) when the worker died is asked again, nothing that has an answer
    again = [t for t in set(asked(folder)) if asked(folder).count(t) > 1]
    assert len(set(asked(folder))) == 60 and len(again) <= 16 and not kept & set(again)
    assert all(r.translated_text == r.text.upper() for r in out if r.category == "text" and r.text) and sum(r.translated_text is None for r in out) == 2
    done = len(asked(folder))
    translation_cache.translate_cached(p, Logged(str(folder)), "en", "de", cache, "3", size=2).collect()
    assert len(asked(folder)) == done
    translation_cache.translate_cached(p, Logged(str(folder)), "en", "fr", cache, "4", size=2).collect()
    assert len(asked(folder)) == done + 60


def test_failed_texts_alone_are_asked_again(spark, tmp_path):
    cache = translation_cache.TranslationCache(spark, f"{tmp_path}/cache")
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    p = rows(spark, 20)
    first = translation_cache.translate_cached(p, Logged(str(tmp_path / "a"), fail="t005"), "en", "de", cache, "1", size=2).collect()
    failed = {r.text for r in first if r.error_class}
    assert "t005" in failed and len(failed) <= 2 and {r.error_class for r in first} == {None, "ConfigurationError"}
    second = translation_cache.translate_cached(p, Logged(str(tmp_path / "b")), "en", "de", cache, "2", size=2).collect()
    assert set(asked(tmp_path / "b")) == failed and not any(r.error_class for r in second)
    with pytest.raises(translate.ConfigurationError):
        translation_cache.translate_cached(p, Logged(str(tmp_path / "b"), fail="t005"), "en", "it", cache, "3", size=2, strict=True)


def test_a_cache_without_texts(spark, tmp_path):
    cache = translation_cache.TranslationCache(spark, f"{tmp_path}/cache")
    assert translation_cache.translate_cached(rows(spark, 0).where("false"), translate.MockBackend(), "en", "de", cache, "1").collect() == []
    assert cache.rows().count() == 0 and not scratch.exists(spark, f"{tmp_path}/cache")


class Slow:
    name, max_text_length = "slow", None

    def __init__(self, seconds, limit=4, size=1, fails=()):
        self.seconds, self.concurrency, self.batch_size, self.fails = seconds, limit, size, list(fails)
        self.lock, self.now, self.most, self.calls, self.begun = threading.Lock(), 0, 0, 0, []

    def translate_batch(self, texts, source, target):
        with self.lock:
            self.calls += 1
            self.now += 1
            self.most = max(self.most, self.now)
            self.begun.append(time.monotonic())
            error = self.fails.pop(0) if self.fails else None
        time.sleep(self.seconds)
        with self.lock:
            self.now -= 1
        if error:
            raise error
        return [t[::-1] for t in texts]


def test_no_more_calls_than_the_limit():
    texts = [f"text {i}" for i in range(40)]
    for limit in (1, 4, 10):
        slow = Slow(0.02, limit)
        began = time.monotonic()
        out = asking.ask(slow, texts, "en", "de")
        took = time.monotonic() - began
        assert [o.result for o in out] == [t[::-1] for t in texts]
        assert slow.most == limit and 0.02 * 40 / limit <= took < 0.02 * 40 / limit + 0.5


def test_a_pause_holds_for_all_calls():
    slow = Slow(0.01, 3, fails=[translate.RateLimited("wait", 0.3)])
    out = asking.ask(slow, [str(i) for i in range(12)], "en", "de", delay=0.0)
    assert all(o.result for o in out) and slow.calls == 13
    gaps = [b - a for a, b in zip(slow.begun, slow.begun[1:])]
    assert max(gaps) > 0.25 and slow.begun[-1] - slow.begun[0] > 0.3


def test_a_used_up_quota_ends_the_queue():
    slow = Slow(0.01, 2, fails=[None, None, translate.QuotaError("over")])
    out = asking.ask(slow, [str(i) for i in range(50)], "en", "de")
    assert slow.calls <= 5 and {o.error_class for o in out} == {None, "QuotaError"} and out[-1].error_class == "QuotaError"
    assert sum(o.result is not None for o in out) >= 2


def test_parts_of_a_long_text_share_its_outcome():
    class Short(Slow):
        max_text_length = 10

    out = asking.ask(Short(0.0, 3), ["one. two. three. four.", "x"], "en", "de")
    assert out[1].result == "x" and out[0].error_class is None and out[0].result.count(" ") >= 2
    out = asking.ask(Short(0.0, 1, fails=[None, translate.ConfigurationError("no")]), ["one. two. three. four.", "x"], "en", "de")
    assert out[0].error_class == "ConfigurationError" and out[0].result is None and out[1].result == "x"


def test_errors_of_a_task_keep_their_class(spark):
    p = rows(spark, 4)
    with pytest.raises(Exception, match="told to"):
        translate.translate_paragraphs(p, Logged("/tmp", fail="t002"), "en", "de").collect()
    assert isinstance(asking.raised(asking.Outcome(None, "QuotaError", "x")), translate.QuotaError)


def test_status_of_too_many_requests():
    from quirework.operators import backends

    with pytest.raises(translate.RateLimited):
        backends.check_status(429)
    calls = []

    def send(url, body, headers):
        calls.append(url)
        return 200, '[[["ok"]]]'

    out = asking.ask(backends.QueryBackend("http://x", send=send), ["a", "b", "c"], "en", "de")
    assert [o.result for o in out] == ["ok"] * 3 and len(calls) == 3 and asking.limit_of(backends.QueryBackend("http://x")) == 5
