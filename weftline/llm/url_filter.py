"""URL verdicts: host and path rules, else a naive Bayes score of segmented host and path words."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import drop, hash_sample, stash

#: Rules as (verdict, host and path), fixed values of the production query.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

#: Labelled sample: words of hosts and paths that were judged unwanted, and of ordinary ones, one name a line.
UNWANTED = """
cheap pills online|best casino bonus|free bets today|adult video chat|win money casino|ads track pixel|spam farm links|click ads network
discount pills pharmacy|live sex cams|poker slots jackpot|buy followers cheap|free porn tube|payday loans fast|replica watches outlet|hot singles dating
crack keygen download|warez torrent free|adult x tube|casino win slots|track clicks pixel|link farm seo|free spins casino|bets odds gambling
viagra cialis pills|escort adult girls|malware exe crack|phishing login verify|get rich quick money|miracle weight loss pills|xxx porn movies|lottery jackpot win
sportsbook bets casino|spam mail blast|popup ads banner|ad tracker beacon|fake followers likes|bitcoin doubler win|nude cams live|steroids pills buy
online casino slots|cheap viagra buy|porn cams free|adult dating singles|betting odds bonus|poker bonus free|instant payday loans|replica handbags cheap
seo backlinks cheap|buy likes fast|torrent movies free|keygen serial crack|jackpot slots spins|escort dating cams|pharmacy no prescription|roulette casino win
gambling sportsbook free|bonus spins jackpot|crypto doubler fast|ads popunder network|tracker pixel ads|spam bulk mail|xxx adult cams|hot nude girls
"""
ORDINARY = """
daily news paper|city public library|school of music|garden plants guide|weather map today|open science journal|health clinic care|travel notes blog
cook book recipes|history museum art|family photo album|local sports club|university research lab|software docs help|community forum wiki|bird watch society
online learning course|free software project|best book review|live music hall|watch repair shop|video game wiki|money and budget advice|farm fresh food
track and field club|home loans advice|win the race sports|chat with experts help|adult education school|hot weather tips|link to the past|play chess club
bank of the north|land and sea survey|hand made craft|west end theatre|house and home|green energy news|blue water sailing|country walks map
public health news|science museum guide|music school lessons|local history society|open data library|garden club recipes|city travel map|university press journal
research data archive|community theatre club|weather news blog|children book club|software project wiki|family health advice|art gallery tours|energy policy review
sports news daily|school lunch recipes|animal care clinic|railway history museum|language learning guide|film review blog|photo art journal|mountain rescue team
"""


class Model(NamedTuple):
    words: dict[str, float]  # log probability
    total: float
    weights: dict[str, float]  # log P(word | unwanted) - log P(word | ordinary)
    prior: float
    sizes: tuple[int, ...]  # lengths of the known words, ascending


def _samples(text: str) -> list[list[str]]:
    return [name.split() for line in text.strip().split("\n") for name in line.split("|")]


def train(unwanted: list[list[str]] | None = None, ordinary: list[list[str]] | None = None, common: Counter | None = None, prior: float = 0.35) -> Model:
    """Word probabilities for segmentation, and multinomial naive Bayes weights with add-one smoothing.

    ``unwanted`` and ``ordinary`` are the labelled names as word lists; ``common`` adds counts of further words that
    segmentation should know, such as those of the paths of all pages. ``prior`` is the share of unwanted names.
    """
    bad = Counter(w for s in (unwanted or _samples(UNWANTED)) for w in s)
    good = Counter(w for s in (ordinary or _samples(ORDINARY)) for w in s)
    known = Counter({w: 20 * n for w, n in (bad + good).items()})
    rest, scale = Counter(common or {}), sum(known.values()) / max(1, sum((common or {}).values()))
    for w, n in rest.items():
        known[w] += max(1, int(n * scale))
    total, vocabulary = sum(known.values()), len(bad.keys() | good.keys())
    weight = lambda w: math.log((bad[w] + 1) / (bad.total() + vocabulary)) - math.log((good[w] + 1) / (good.total() + vocabulary))
    return Model({w: math.log(n / total) for w, n in known.items()}, math.log(total), {w: weight(w) for w in bad.keys() | good.keys()}, math.log(prior / (1 - prior)), tuple(sorted({len(w) for w in known})))


def segment(name: str, model: Model) -> list[str]:
    """The most probable split of a run of letters under the unigram model (Viterbi); unknown pieces cost by length.

    A piece is a known word or any unknown run. The cost of an unknown run grows evenly with its letters, so the best
    one that ends at a letter follows from the best one that ends before it, and time is linear in the name.
    """
    letter = math.log(10)
    best, back = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
    open_, since = -math.inf, 0  # the best unknown run that ends here, and its start
    for end in range(1, len(name) + 1):
        begun = best[end - 1] + letter - model.total
        if begun > open_:
            open_, since = begun, end - 1
        open_ -= letter
        best[end], back[end] = open_, since
        for size in model.sizes:
            if size > end:
                break
            if (p := model.words.get(name[end - size : end])) is not None and best[end - size] + p > best[end]:
                best[end], back[end] = best[end - size] + p, end - size
    out, end = [], len(name)
    while end:
        out.append(name[back[end] : end])
        end = back[end]
    return out[::-1]


def words_of(text: str, model: Model) -> list[str]:
    return [w for run in re.findall(r"[a-z]+", text.lower()) for w in segment(run, model)]


def score(host: str, path: str, model: Model) -> float:
    """Log odds of unwanted; words without labelled evidence count nothing."""
    return model.prior + sum(model.weights.get(w, 0.0) for w in words_of(host, model) + words_of(path, model))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    _, sign, rest = (url or "").partition("://")
    if not sign:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return lower, re.match(r"[^?#]*", rest[len(host) :])[0]


def _compile(rules) -> dict[str, list[tuple[str, str, str]]]:
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        by_host.setdefault(host, []).append((slash + path, rule, verdict))
    return {h: sorted(v, key=lambda x: (-len(x[0]), x)) for h, v in by_host.items()}


def match(host: str, path: str, rules: dict[str, list[tuple[str, str, str]]]) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule whose host is the url's or a parent domain and whose path begins the url's."""
    found, labels = [], host.split(".")
    for k in range(len(labels)):
        for start, rule, verdict in rules.get(".".join(labels[k:]), []):
            if path.startswith(start):
                found.append((-len(rule), rule, verdict))
                break
    return min(found)[1:] if found else None


def path_words(pages: DataFrame, url_col: str = "url", share: float = 1e-6) -> Counter:
    """Counts of the words (runs of ASCII letters) of all paths whose share of all words is at least ``share``.

    Every path is counted; the least share bounds the number of words by its inverse, whatever the table.
    """
    path = F.regexp_extract(F.col(url_col), r"^.*?://[^/?#]*([^?#]*)", 1)
    counts = pages.select(F.explode(F.regexp_extract_all(F.lower(path), F.lit(r"([a-z]{2,})"), 1)).alias("word")).groupBy("word").count()
    counts = stash(counts, "words")
    total = counts.agg(F.sum("count")).first()[0] or 0
    found = Counter({r["word"]: r["count"] for r in counts.where(F.col("count") >= share * total).collect()})
    drop(counts)
    return found


def labelled_names(labelled: DataFrame, url_col: str = "url", label_col: str = "unwanted", sample: int = 20000) -> tuple[list[list[str]], list[list[str]]]:
    """Unwanted and ordinary names, as lists of words, from at most ``sample`` labelled urls (those with the least hash).

    A label of 1 or true is unwanted; urls and labels that are null take no part. The words of a name are the runs of
    ASCII letters of its host and path; runs without a sign between their words are learned as one word.
    """
    rows = labelled.select(F.col(url_col).alias("url"), F.col(label_col).cast("int").alias("label")).where("url is not null and label is not null")
    out: tuple[list, list] = ([], [])
    for r in hash_sample(rows, "url", sample).collect():
        out[r.label != 1].append(re.findall(r"[a-z]+", " ".join(split_url(r.url)).lower()))
    return out


def judge_urls(pages: DataFrame, url_col: str = "url", rules=RULES, model: Model | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """The input's columns in a struct ``row``, with host, path, rule and verdict.

    A rule that fits decides; of several the longest. Other urls are blocked when the naive Bayes log odds of their
    segmented host and path words are above 0, and allowed else, as are null and empty urls. Without a ``model`` one is
    trained on the ``labelled`` urls, or on the sample of this module; its segmentation also knows the words of all
    paths (see ``path_words``), so it depends on the table. Rules are a parameter held in each task. Repeated rows have
    equal verdicts, time is linear in a url's length, and clashing column names need no care.
    """
    if model is None:
        names = labelled_names(labelled, url_col) if labelled is not None else (None, None)
        model = train(*names, common=path_words(pages, url_col))
    shared = pages.sparkSession.sparkContext.broadcast((model, _compile(rules)))
    kept = pages.select(F.struct("*").alias("row")).schema["row"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value

        @lru_cache(100_000)
        def evidence(text: str) -> float:
            return sum(model.weights.get(w, 0.0) for w in words_of(text, model))

        for batch in batches:
            out = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                fit = match(host, path, known)
                verdict = fit[1] if fit else "block" if host and model.prior + evidence(host) + evidence(path) > 0 else "allow"
                out.append((host, path, fit and fit[0], verdict))
            columns = [pa.array(c, pa.string()) for c in (zip(*out, strict=True) if out else [[]] * 4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["row", "host", "path", "rule", "verdict"])

    return pages.select(F.struct("*").alias("row"), F.col(url_col).alias("url")).mapInArrow(judge, f"row {kept}, host string, path string, rule string, verdict string")


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", **options) -> DataFrame:
    """Per page: the id, host, path, rule (null where none fits) and verdict; see ``judge_urls``."""
    return judge_urls(pages.select(id_col, url_col), url_col, **options).select(F.col(f"row.`{id_col}`").alias(id_col), "host", "path", "rule", "verdict")
