"""URL filters: rules first, then logistic regression on hashed character n-grams.

``judge`` splits a URL into host and path, applies the longest fitting rule and
asks the classifier about the rest.  The classifier learns from a small labelled
table of URLs (a parameter; by default ``LABELLED``, written out of general
topics).  N-grams of host and path have separate hashed places, and both tell
something: a tame host with a bad path is weighed by both.

Defined results: a null URL, or one without ``://``, has empty host and path,
fits no rule and is allowed; of rules equally long, the first by name wins; a
score of exactly 0 allows; repeated rows get equal verdicts, an empty table none;
columns besides the key and the URL are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coterie.llm.common import Memo, prepare

#: Fixed values: (verdict, host, start of the path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Topics of the labelled training URLs: words of hosts and words of paths.
BLOCKED_TOPICS = {
    "casino poker roulette jackpot slots blackjack gamble": "free-spins deposit-bonus big-win jackpot play-slots",
    "bet mybets betting odds bookmaker wager": "place-bet free-bet live-odds betting-tips",
    "pills pharmacy viagra cheap-meds drugstore tablets": "buy-pills no-prescription discount-meds order-cheap",
    "adult sex porn xxx nude cams escort": "xxx-videos live-sex nude-pics adult-chat",
    "spammer bulk-mail linkfarm backlinks seo-links clickbait": "buy-backlinks link-list mass-mail spam",
    "adserver ads banner tracker tracking popunder pixel": "adclick track-click popup pixel-gif impression",
    "warez crack keygen torrent nulled serials": "download-crack keygen-free full-cracked torrent-file",
    "phishing login-verify account-secure wallet-unlock": "verify-account confirm-password unlock-wallet signin-update",
    "payday loans quick-cash credit-fix lottery": "instant-loan easy-money claim-prize lottery-winner",
    "miracle-diet weight-loss hair-growth": "lose-weight-fast miracle-cure one-weird-trick",
}
ALLOWED_TOPICS = {
    "news herald gazette tribune journal chronicle": "world politics opinion archive",
    "university college school institute faculty": "courses research library students",
    "library archive museum gallery heritage": "collections exhibits catalogue visit",
    "docs developer manual reference wiki": "guide tutorial api-reference changelog",
    "weather climate astronomy geology biology": "forecast maps observations data",
    "recipes kitchen garden bakery farm-shop": "seasonal soups vegetables bread",
    "hospital clinic health medicine nursing": "patients advice departments vaccines",
    "city council county government ministry": "services planning transport statistics",
    "forum community club society choir orchestra": "threads members events concerts",
    "travel railway harbour mountain cycling": "routes timetable hotels trails",
}
PREFIXES = ("", "www.", "blog.", "m.", "shop.")
ENDINGS = ("com", "net", "org", "info", "co.uk", "io", "de")
NEUTRAL = ("", "contact", "about", "articles/{}", "en/{}", "{}.html", "index.html", "p/{}/", "fr/{}", "2020/{}", "de/{}/", "page-{}", "es/{}")


def plain_name(i: int) -> str:
    """The ``i``-th name without a topic: two to four open syllables."""
    h = zlib.crc32(str(i).encode())
    return "".join("bcdfghjklmnprstvwyz"[h // 101**k % 19] + "aeiou"[h // 7 // 101**k % 5] + "nrsl"[: h // 3**k % 2][:1] for k in range(2 + h % 3))


def labelled_urls() -> list[tuple[str, str]]:
    """``(url, label)`` rows by a fixed rule.

    Every topic's hosts stand alone, beside a name without a topic and beside the topic's next word, each
    with a path of the topic and with a neutral one; most rows are names without a topic, which are allowed
    unless their path is of a blocked topic.  Prefixes, endings and neutral paths are dealt by a hash of the
    host, so alike to both labels.
    """
    rows: list[tuple[str, str]] = []

    def add(host: str, label: str, word: str = "") -> None:
        h = zlib.crc32(f"{host} {word}".encode())
        tail = f"{word}/{h % 900}" if word and h % 2 else word or NEUTRAL[h // 64 % len(NEUTRAL)].format(h % 9000)
        rows.append((f"https://{PREFIXES[h // 4 % 5]}{host}.{ENDINGS[h // 16 % 7]}/{tail}", label))

    for label, topics in (("block", BLOCKED_TOPICS), ("allow", ALLOWED_TOPICS)):
        for n, (hosts, paths) in enumerate(topics.items()):
            names, words = hosts.split(), paths.split()
            for i, name in enumerate(names):
                for j, host in enumerate((name, f"{name}-{plain_name(50 * n + i)}", plain_name(50 * n + i + 25) + name, f"{name}-{names[(i + 1) % len(names)]}")):
                    add(host, label)
                    add(host, label, words[(i + j) % len(words)])
            for i, word in enumerate(words):
                add(plain_name(1000 + 10 * n + i), label, word)
                add(plain_name(2000 + 10 * n + i), label, f"{word}-{words[i - 1]}")
    for i in range(500):
        add(plain_name(3000 + i), "allow")
    return rows


LABELLED = labelled_urls()

_DIGITS = re.compile("[0-9]+")
PLACES = 1 << 14
GRAMS = (3, 4, 5)
STEPS, RATE, PENALTY = 400, 2.0, 3e-5


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule, or nulls."""
    name = verdict = None
    for what, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path) if name is None else name.when(fits, rule_host + rule_path)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def places(kind: str, text: str) -> np.ndarray:
    """Hashed places of all n-grams; a run of digits counts as one 0, since numbers tell nothing."""
    marked = f"^{_DIGITS.sub('0', text)}$"
    return np.array([zlib.crc32(f"{kind}{marked[i : i + n]}".encode()) % PLACES for n in GRAMS for i in range(len(marked) - n + 1)], dtype=np.int64)


def split_url(url: str) -> tuple[str, str]:
    rest = url.split("://", 1)[1] if "://" in url else ""
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host = rest[: min(ends)] if ends else rest
    path = rest[len(host) :]
    ends = [path.find(c) for c in "?#" if c in path]
    return host.translate({c: c + 32 for c in range(65, 91)}), path[: min(ends)] if ends else path


class Classifier:
    """Weights of hashed n-grams; each part is scaled by the root of its number of n-grams."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def part(self, kind: str, text: str) -> float:
        p = places(kind, text)
        return float(self.weights[p].sum() / np.sqrt(len(p))) if len(p) else 0.0


def train(labelled: list[tuple[str, str]] | None = None) -> Classifier:
    """Fit on ``(url, block or allow)`` rows; the table is small (it is laid out on the driver)."""
    urls = [(u, 1.0 if label == "block" else -1.0) for u, label in (LABELLED if labelled is None else labelled)]
    rows, columns, values = [], [], []
    for i, (u, _) in enumerate(urls):
        for kind, text in zip("hp", split_url(u), strict=True):
            if len(p := places(kind, text)):
                rows.append(np.full(len(p), i))
                columns.append(p)
                values.append(np.full(len(p), 1 / np.sqrt(len(p))))
    weights, bias = np.zeros(PLACES), 0.0
    if not rows:
        return Classifier(weights, bias)
    row, column, value = map(np.concatenate, (rows, columns, values))
    y = np.array([v for _, v in urls])
    now = ahead = np.zeros(PLACES + 1)
    for step in range(STEPS):  # accelerated descent; the last number is the bias, which is not penalised
        margin = np.bincount(row, ahead[column] * value, len(y)) + ahead[-1]
        slope = -y / (1 + np.exp(np.clip(y * margin, -30, 30))) / len(y)
        gradient = np.append(np.bincount(column, slope[row] * value, PLACES) + PENALTY * ahead[:-1], slope.sum())
        after = ahead - RATE * gradient
        ahead, now = after + step / (step + 3) * (after - now), after
    return Classifier(now[:-1], float(now[-1]))


def judge(pages: DataFrame, rules=RULES, model: Classifier | None = None, key: str = "page_id", url: str = "url") -> DataFrame:
    """``key, host, path, rule, verdict, score`` for every row; ``score`` is the log-odds of blocking."""
    prepare(pages.sparkSession)
    model = model or train()
    host, path = parts(F.col("url"))
    split = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url")).select("key", host.alias("host"), path.alias("path"))
    name, verdict = best_rule(F.col("host"), F.col("path"), rules)
    ruled = split.select("key", "host", "path", name.alias("rule"), verdict.alias("verdict"))
    schema = T.StructType([*ruled.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches):
        # hosts and paths repeat; both memos are bounded
        memos = [Memo(lambda s, k=k: model.part(k, s), 8 << 20) for k in "hp"]
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            scores = [memos[0][h] + memos[1][p] + model.bias if h else -abs(model.bias) - 1.0 for h, p in zip(hosts, paths, strict=True)]
            verdicts = [v or ("block" if s > 0 else "allow") for v, s in zip(batch.column(4).to_pylist(), scores, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())], schema.names)

    return ruled.mapInArrow(run, schema).withColumnRenamed("key", key)
