"""URL filters: association rules over URL tokens.

Spark's FP-growth mines frequent combinations of the tokens of labelled URLs together with their labels; rules "tokens =>
label" that are confident and supported enough are kept, less those that a shorter rule already implies. URLs are judged
through an inverted index from a rule's rarest token to the rule. Rules that people wrote, by host and path, come first.

FP-growth makes all subsets of a frequent set. Tokens that stand in the same URLs only, which would double them each, are
one item; where URLs still have more than ``LONGEST`` items, the same rules are found level by level instead, through
those combinations alone that can still make new ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, bounded_batches, materialise

#: (verdict, host, start of path)
SITE_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// or for null."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def site_rule(host: Column, path: Column, rules=SITE_RULES) -> tuple[Column, Column]:
    """(rule as host + path, verdict) of the longest rule that fits, else nulls.

    A rule fits its host and all subdomains where the path starts with the rule's. Rules are few and a fixed
    parameter, so that one expression holds them all.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def url_tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a URL, marked by where they stand: host labels, path parts with numbers as one token, and query keys."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "0")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, "^([^=]*)", 1)))
    scheme = F.array(F.concat(F.lit("s:"), F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^(.*?)://", 1)))
    return F.array_distinct(F.filter(F.concat(scheme, labels, parts, keys), lambda x: F.length(x) > 2))


#: Items of a URL up to which FP-growth mines: it finds at most 2**LONGEST / min_support combinations then.
LONGEST = 14


@dataclass(frozen=True)
class UrlRules:
    """Mined rules: (items, verdict, confidence, support), best first; the verdict where none fits; and token -> item for
    those tokens that aren't their own: an item is one token, or several that stand in the same labelled URLs only. A
    URL has an item if it has one of its tokens."""

    rules: tuple[tuple[tuple[str, ...], str, float, float], ...]
    default: str
    items: dict[str, str] = field(default_factory=dict)

    def by_token(self) -> Iterator[tuple[tuple[str, ...], str, float, float]]:
        """The same rules, each as all those of single tokens."""
        tokens: dict[str, list[str]] = {}
        for t, item in self.items.items():
            tokens.setdefault(item, [item]).append(t)
        for items, *rest in self.rules:
            for chosen in product(*[tokens.get(i, [i]) for i in items]):
                yield tuple(sorted(chosen)), *rest


def mine(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.8) -> UrlRules:
    """Rules from rows (tokens, label), label "allow" or "block"; rows without label, and tokens that are null, teach nothing.

    A rule has the support of its rows with its label, and confidence above that label's share; no rule of some of its
    items has as much confidence. Only tokens that reach the support can be in a rule; there are at most 1 / min_support *
    (tokens a URL) of them, and all of them are mined, of every URL, in combinations of any length.
    """
    rows = labelled.where("label IS NOT NULL").select(F.coalesce(F.filter("tokens", lambda t: t.isNotNull()), F.array().cast("array<string>")).alias("tokens"), "label")
    by_label = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    total = sum(by_label.values())
    default = max(sorted(by_label), key=by_label.get) if by_label else "allow"
    if len(by_label) < 2:
        return UrlRules((), default)
    least = max(1, math.ceil(min_support * total - 1e-9))
    frequent = rows.select(F.explode(F.array_distinct("tokens")).alias("t")).groupBy("t").count().where(F.col("count") >= least)
    names = sorted(r["t"] for r in frequent.collect())
    if not names:
        return UrlRules((), default)
    kept = F.sort_array(F.array_intersect("tokens", F.array(*map(F.lit, names))))
    baskets = materialise(rows.groupBy(kept.alias("tokens"), "label").count(), "baskets")
    # tokens of the same baskets, told by two sums over these of 64 hashed bits
    marks = [F.sum(F.xxhash64("tokens", "label", F.lit(k)).cast("decimal(38,0)")).alias(f"m{k}") for k in range(2)]
    same: dict[tuple, list[str]] = {}
    for r in baskets.select(F.explode("tokens").alias("t"), "*").groupBy("t").agg(*marks).collect():
        same.setdefault((r["m0"], r["m1"]), []).append(r["t"])
    items = {t: min(ts) for ts in same.values() for t in ts if t != min(ts)}
    if items:
        others = F.array(*map(F.lit, sorted(items)))
        baskets = materialise(baskets.withColumn("tokens", F.array_except("tokens", others)), "item-baskets")
    longest = baskets.agg(F.max(F.size("tokens"))).first()[0]
    found = _grown if longest <= LONGEST else _levels
    rules: list[tuple[frozenset, str, float, float]] = []
    for tokens, label, m, n in found(baskets, by_label, least, min_confidence):  # by length
        if m >= least and m / n >= min_confidence and m / n > by_label[label] / total and not any(x == label and c >= m / n and k < tokens for k, x, c, _ in rules):
            rules.append((tokens, label, m / n, m / total))
    out = [(tuple(sorted(k)), label, c, s) for k, label, c, s in rules]
    return UrlRules(tuple(sorted(out, key=lambda r: (-r[2], -r[3], r[0]))), default, items)


def _grown(baskets: DataFrame, by_label: dict[str, int], least: int, min_confidence: float) -> Iterator[tuple[frozenset, str, int, int]]:
    """(items, label, rows with both, rows with the items) of all combinations that have the support and the confidence, by length, from FP-growth."""
    from pyspark.ml.fpm import FPGrowth

    total, mark = sum(by_label.values()), "="
    rows = baskets.select(F.explode(F.sequence(F.lit(1), F.col("count"))), "tokens", "label").select(F.concat("tokens", F.array(F.concat(F.lit(mark), "label"))).alias("items"))
    # a little below the least, as FP-growth takes the ceiling of share times rows
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / total).fit(rows)
    sets = model.freqItemsets.select(F.sort_array(F.filter("items", lambda t: ~t.startswith(mark))).alias("tokens"), F.get(F.filter("items", lambda t: t.startswith(mark)), F.lit(0)).alias("label"), "freq").where("size(tokens) > 0")
    sets = materialise(sets, "item-sets")
    both = sets.where("label IS NOT NULL").join(sets.where("label IS NULL").select("tokens", F.col("freq").alias("n")), "tokens").where(F.col("freq") >= F.lit(min_confidence) * F.col("n"))
    for r in both.orderBy(F.size("tokens"), "tokens", "label").toLocalIterator():
        yield frozenset(r["tokens"]), r["label"][len(mark) :], r["freq"], r["n"]


def _levels(baskets: DataFrame, by_label: dict[str, int], least: int, min_confidence: float) -> Iterator[tuple[frozenset, str, int, int]]:
    """The same, less what makes no new rule, level by level.

    A combination is counted where all that are one item shorter can still grow. One can't if no label has the support
    with it, if it has as many rows as a shorter one of its items, or if all its rows have one label: what is longer
    makes no rule then that a shorter one doesn't make with at least the same confidence.
    """
    labels = sorted(by_label)
    counts: dict[tuple[str, ...], int] = {(): sum(by_label.values())}
    growing, size = {()}, 0
    while growing:
        size += 1
        grown = set()
        for items, by in sorted(_counted(baskets, growing, size, labels, least).items()):
            n = sum(by)
            if any(counts[items[:k] + items[k + 1 :]] == n for k in range(size) if size > 1):
                continue
            counts[items] = n
            for label, m in zip(labels, by, strict=True):
                yield frozenset(items), label, m, n
            if max(by) >= least and max(by) < n:
                grown.add(items)
        growing = grown


def _counted(baskets: DataFrame, growing: set[tuple[str, ...]], size: int, labels: list[str], least: int) -> dict[tuple[str, ...], list[int]]:
    """Rows by label of each combination of ``size`` items that has ``least`` rows, and whose shorter ones are all in growing."""
    import pyarrow as pa

    begins = {g[:k] for g in growing for k in range(size)}

    def within(items: list[str], at: int, start: tuple[str, ...]):
        """The growing combinations in items[at:] that begin with start, through beginnings of such alone."""
        if len(start) == size - 1:
            if start in growing:
                yield start, at
            return
        for k in range(at, len(items)):
            if (longer := (*start, items[k])) in begins:
                yield from within(items, k + 1, longer)

    def count(batches):
        seen: dict[tuple, int] = {}

        def out():
            keys = list(seen)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.list_(pa.string())), pa.array([k[1] for k in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())], names=["items", "label", "n"])

        for batch in bounded_batches(batches):
            for tokens, label, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for start, at in within(tokens, 0, ()):
                    for t in tokens[at:]:
                        items = (*start, t)
                        if size == 1 or all(items[:k] + items[k + 1 :] in growing for k in range(size - 1)):
                            seen[items, label] = seen.get((items, label), 0) + n
                            if len(seen) > 100_000:
                                yield out()
                                seen.clear()
        yield out()

    sums = [F.sum(F.when(F.col("label") == x, F.col("n")).otherwise(0)).alias(f"n{k}") for k, x in enumerate(labels)]
    found = baskets.select("tokens", "label", "count").mapInArrow(count, "items array<string>, label string, n long").groupBy("items").agg(*sums)
    return {tuple(r["items"]): list(r[1:]) for r in found.where(sum(F.col(f"n{k}") for k in range(len(labels))) >= least).toLocalIterator()}


def judge_mined(tokens: Column, rules: UrlRules) -> Column:
    """The verdict of the best mined rule that fits, found by an inverted index: item -> rules that need it first."""
    if not rules.rules:
        return F.lit(rules.default)
    use: dict[str, int] = {}
    for items, *_ in rules.rules:
        for t in items:
            use[t] = use.get(t, 0) + 1
    index: dict[str, list[int]] = {}
    for n, (items, *_) in enumerate(rules.rules):
        index.setdefault(min(items, key=lambda t: (use[t], t)), []).append(n)
    if named := [x for t, item in sorted(rules.items.items()) if item in use for x in (F.lit(t), F.lit(item))]:
        item_of = F.create_map(*named)
        tokens = F.transform(tokens, lambda t: F.coalesce(item_of[t], t))
    lists = F.create_map(*[x for t, n in index.items() for x in (F.lit(t), F.array(*map(F.lit, n)))])
    needs = F.array(*[F.array(*map(F.lit, items)) for items, *_ in rules.rules])
    verdicts = F.array(*[F.lit(v) for _, v, *_ in rules.rules])
    candidates = F.flatten(F.filter(F.transform(tokens, lambda t: lists[t]), lambda x: x.isNotNull()))
    fits = F.filter(candidates, lambda n: F.forall(F.get(needs, n), lambda t: F.array_contains(tokens, t)))
    return F.coalesce(F.get(verdicts, F.array_min(fits)), F.lit(rules.default))


def judge_urls(pages: DataFrame, rules=SITE_RULES, mined: UrlRules | None = None, id_col: str = "page_id", url_col: str = "url", **mining) -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict.

    Site rules come first, the longest that fits; ``rule`` is its host and path. Other URLs get the verdict of mined
    rules, which are learned from the URLs that site rules judge: those are the labels. Null URLs and those without ://
    have empty host and path, no rule, and the verdict of mined rules on no tokens, which is the commoner label ("allow"
    where there are none). Null and repeated ids stay as they are; empty tables give empty results; other columns of
    pages are not read.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias(id_col), url.alias("_url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = site_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("_verdict"), url_tokens(F.col("host"), F.col("path"), F.col("_url")).alias("_tokens"))
    if mined is None:
        mined = mine(rows.select(F.col("_tokens").alias("tokens"), F.col("_verdict").alias("label")), **mining)
    return rows.select(id_col, "host", "path", "rule", F.coalesce("_verdict", judge_mined(F.col("_tokens"), mined)).alias("verdict"))
