"""URL filters: host and path rules, and a character model where no rule fits.

URLs that a rule accepts or rejects teach two smoothed variable-order Markov models over the
bytes of host and path. A URL's score is the difference of its log-likelihoods a byte; the
threshold is calibrated on rule-labelled URLs that the models have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import hash_share, table
from tessera.session import cut

#: (host/path, verdict)
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Rule-labelled URLs of each verdict that the models and the threshold are fitted on, about, at most.
FIT_URLS = 20_000
#: Bytes of such URLs of each verdict, about, at most: they bound the n-grams that are counted, about six a byte.
FIT_BYTES = 2_000_000
#: Bytes of context at most. With the byte after it and the length an n-gram fits into a long.
ORDER = 5
#: Strength of the next shorter context in each estimate.
BACK_OFF = 2.0
UPPER, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for URLs without ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER_CASE), F.regexp_extract(text, pattern, 2)


def rule_and_verdict(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: len(r[0])):
        where, under = text.split("/", 1)
        fits = ((host == where) | host.endswith(f".{where}")) & path.startswith(f"/{under}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(keys, text numbers): each byte of each text with 0 to ``order`` bytes before it, packed into longs.

    keys has a row for each number of bytes before; 0 stands where the text has not so many, so
    that a column holds one byte. A zero byte stands at both ends of a text. A key is the
    number of bytes and the bytes.
    """
    joined = np.frombuffer(b"".join(b"\0" + t + b"\0" for t in texts), np.uint8).astype(np.int64)
    sizes = np.array([len(t) + 2 for t in texts], np.int64)
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.arange(len(joined)) - begin
    keys = np.zeros((order + 1, len(joined)), np.int64)
    packed = np.zeros(len(joined), np.int64)
    for k in range(order + 1):
        packed[k:] += joined[: len(joined) - k] << (8 * k)
        keys[k] = np.where(at >= max(k, 1), packed | ((k + 1) << 48), 0)
    # The first byte of a text is only a context.
    inside = at >= 1
    return keys[:, inside], np.repeat(np.arange(len(texts)), sizes)[inside]


def context_keys(keys: np.ndarray) -> np.ndarray:
    """The keys of the contexts alone: one byte less at the end."""
    return np.where(keys == 0, 0, ((keys & ((1 << 48) - 1)) >> 8) | (keys >> 48 << 48) | (1 << 56))


class Markov:
    """Interpolated variable-order models: an unseen context leaves the estimate to the next shorter one.

    keys: the n-grams, sorted; seen: how often each occurs, a column for each model. Arrays only:
    about 16 bytes for an n-gram and two models.
    """

    def __init__(self, keys: np.ndarray, seen: np.ndarray):
        self.keys, self.seen = keys, seen
        contexts = context_keys(keys)
        order = np.argsort(contexts, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], np.diff(contexts[order]) != 0])) if len(keys) else np.zeros(0, np.int64)
        self.contexts = contexts[order][begin]
        self.after = np.add.reduceat(seen[order], begin, axis=0) if len(keys) else seen

    @staticmethod
    def _look(table: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.zeros((len(wanted), values.shape[1]), values.dtype)
        at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
        return np.where((table[at] == wanted)[:, None], values[at], 0)

    def log_likelihoods(self, texts: list[bytes], order: int = ORDER) -> np.ndarray:
        """[texts, models]: log probability of each text, its end included."""
        keys, which = grams(texts, order)
        out = np.zeros((len(texts), self.seen.shape[1]))
        if not keys.shape[1]:
            return out
        p = np.full((keys.shape[1], self.seen.shape[1]), 1 / 256)
        # Equal n-grams are looked up once.
        for row in keys:
            some, back = np.unique(row, return_inverse=True)
            n = self._look(self.contexts, self.after, context_keys(some))[back]
            c = self._look(self.keys, self.seen, some)[back]
            p = np.where((row != 0)[:, None] & (n > 0), (c + BACK_OFF * p) / (n + BACK_OFF), p)
        np.add.at(out, which, np.log(p))
        return out


def differences(models: Markov, texts: list[bytes]) -> np.ndarray:
    """Log-likelihood a byte under the accepted URLs' model less that under the rejected ones'."""
    both = models.log_likelihoods(texts)
    return (both[:, 0] - both[:, 1]) / (np.array([len(t) for t in texts], np.int64) + 1)


def calibrate(scores: np.ndarray, accepted: np.ndarray) -> float:
    """The threshold with the least mean error of the two classes; the middle of the best gap."""
    order = np.argsort(scores, kind="stable")
    s, y = scores[order], accepted[order]
    # Cut k rejects the k lowest scores.
    below = np.concatenate([[0], np.cumsum(y)]) / max(1, y.sum())
    above = 1 - np.concatenate([[0], np.cumsum(~y)]) / max(1, (~y).sum())
    wrong = below + above
    valid = np.concatenate([[True], s[1:] > s[:-1], [True]])
    k = int(np.argmin(np.where(valid, wrong, np.inf)))
    if k == 0:
        return float(s[0]) - 1
    return float(s[-1]) + 1 if k == len(s) else float(s[k - 1] + s[k]) / 2


def fit(judged: DataFrame, fit_urls: int = FIT_URLS, fit_bytes: int = FIT_BYTES) -> tuple[np.ndarray, np.ndarray, float] | None:
    """(target: binary, verdict) -> n-grams, their counts under both verdicts, and the threshold; None where a verdict has no URLs.

    About ``fit_urls`` distinct targets of each verdict, of about ``fit_bytes`` bytes, are drawn by
    their hash, so repeated URLs change nothing; three of four teach the models, the fourth sets
    the threshold.
    """
    spark = judged.sparkSession
    known = judged.where("verdict is not null").select("target", "verdict")
    drawn = F.lit(False)
    for said, n, size in known.distinct().groupBy("verdict").agg(F.count("*"), F.sum(F.length("target") + 2)).collect():
        drawn = drawn | ((F.col("verdict") == said) & hash_share(F.col("target"), n, min(fit_urls, int(n * fit_bytes / size))))
    picked = cut(known.where(drawn).distinct())
    part = F.pmod(F.xxhash64("target", F.lit(5)), F.lit(4))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            allowed = np.array(b.column(1).to_pylist()) == "allow"
            keys, which = grams(b.column(0).to_pylist())
            some, back = np.unique(keys.ravel(), return_inverse=True)
            mine = np.tile(allowed[which], len(keys))
            n = [np.bincount(back, weights=w, minlength=len(some)).astype(np.int64) for w in (mine, ~mine)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[0]), pa.array(n[1])], ["g", "allow", "block"]).filter(pa.array(some != 0))

    counts = picked.where(part != 0).mapInArrow(count, "g long, allow long, block long").groupBy("g").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    got = counts.toArrow().sort_by("g")
    keys, seen = got.column("g").to_numpy(), np.stack([got.column(n).to_numpy().astype(np.int32) for n in ("allow", "block")], 1)
    if not seen.sum(0).all():
        return None
    sent = spark.sparkContext.broadcast((keys, seen))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = Markov(*sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(differences(models, b.column(0).to_pylist())), b.column(1)], ["score", "verdict"])

    held = picked.where(part == 0).mapInArrow(score, "score double, verdict string").toArrow()
    threshold = calibrate(held.column("score").to_numpy(), np.array(held.column("verdict").to_pylist()) == "allow") if held.num_rows else 0.0
    return keys, seen, threshold


def judge(pages: DataFrame, rules=RULES, fit_urls: int = FIT_URLS) -> DataFrame:
    """(page_id, url, ...) -> page_id, host, path, rule, verdict, score: a row for each input row.

    The verdict is the longest fitting rule's, else allow where the score (accepted less
    rejected, a byte) is above the calibrated threshold. Null, empty and malformed URLs have
    empty host and path and are scored as an empty text. Where no URL is accepted, or none
    rejected, by a rule, every URL without a rule is allowed and scores are 0.
    """
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_and_verdict(F.col("host"), F.col("path"), rules)
    judged = parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.concat("host", "path").cast("binary").alias("target"))
    model = fit(judged, fit_urls)
    if model is None:
        return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, threshold = Markov(*sent.value[:2]), sent.value[2]
        for b in batches:
            scores = differences(models, b.column("target").to_pylist())
            said = [v or ("allow" if s > threshold else "block") for v, s in zip(b.column("verdict").to_pylist(), scores.tolist())]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("page_id", "host", "path", "rule")), pa.array(said, pa.string()), pa.array(scores, pa.float64())], ["page_id", "host", "path", "rule", "verdict", "score"])

    kind = judged.schema["page_id"].dataType.simpleString()
    return judged.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, score double")


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


QUERIES = {"op5_url_filter": op5_url_filter}
ORACLES: dict[str, str] = {}
