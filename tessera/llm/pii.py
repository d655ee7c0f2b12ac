"""Personal data: exact base patterns, and bootstrapped contextual extraction on top of them.

Base matches of four kinds (email, ip, card, phone) are the seeds. Every token that looks like an identifier is an
instance; the words around it are lexical patterns. Spark scores the graph of patterns and instances in rounds: a
pattern's confidence for a kind is the share of its instances that are known to be of that kind, where those of unknown
kind whose form suits it hardly count, since they are what is looked for; an instance's confidence is the noisy-or of
its confident patterns. Instances that confident patterns discover, and whose form suits the kind, become further spans;
base spans stay as they are.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from . import common

KINDS = ["email", "ip", "card", "phone"]
ROUNDS = 3
#: Distinct known instances that a pattern needs, and what is added to the count of its instances when it is scored.
MIN_SUPPORT = 3
SMOOTHING = 1.0
#: What an instance of unknown kind whose form suits the pattern's kind counts for there.
UNSEEN = 0.1
PATTERN_CONFIDENCE = 0.8
INSTANCE_CONFIDENCE = 0.9
MASK = {kind: f"<{kind}>" for kind in KINDS}

_hint = re.compile(r"[0-9@]").search
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++").finditer
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])++").finditer
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++").match
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_digits = frozenset("0123456789()+-./")
_marked = re.compile(r"[0-9@]\S*+").finditer
_word = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each match is the longest run of local characters before an @ and the domain after it."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _local:
            start -= 1
        if start < at and (m := _domain(text, at + 1)):
            end = m.end()
            yield start, end
        else:
            end = max(end, at + 1)  # no later match can begin before this @
        at = text.find("@", max(end, at + 1))


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers at a time from every chain of numbers joined by single dots."""
    for m in _ip(text):
        at, numbers = m.start(), m[0].split(".")
        for k in range(0, len(numbers) - 3, 4):
            four = numbers[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in four):
                yield at, at + size
            at += size + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _card(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _phone(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            yield m.span()


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), ordered."""
    if not _hint(text):
        return []
    found = (emails(text), ips(text), cards(text), phones(text))
    return sorted((a, kind, b) for kind, spans in enumerate(found) for a, b in spans)


def instances(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, str, list[str]]]:
    """(start, end, kind or -1, surface, patterns) of base spans and of other tokens with three digits or an @.

    Tokens of digits and signs that single spaces separate are one instance. Patterns hold the two words before and the
    one after, wherever they stand, and a sign just before.
    """
    places = [(a, b, kind) for a, kind, b in spans]
    covered, k, last, runs = sorted((a, b) for a, b, _ in places), 0, 0, []
    for m in _marked(text):
        start = m.start()
        while start > last and not text[start - 1].isspace():
            start -= 1
        end = last = m.end()
        digits = _digits.issuperset(text[start:end])
        if digits and runs and runs[-1][2] and start == runs[-1][1] + 1 and text[start - 1] == " ":
            runs[-1][1] = end
        else:
            runs.append([start, end, digits])
    for start, end, _ in runs:
        while start < end and not (text[start].isalnum() or text[start] in "+(@"):
            start += 1
        while start < end and not text[end - 1].isalnum():
            end -= 1
        token = text[start:end]
        if not (sum("0" <= c <= "9" for c in token) >= 3 or "@" in token):
            continue
        while k < len(covered) and covered[k][1] <= start:
            k += 1
        if k < len(covered) and covered[k][0] < end:
            continue
        places.append((start, end, -1))
    words = [m.span() for m in _word.finditer(text)] if places else []
    starts, ends = [a for a, _ in words], [b for _, b in words]
    for start, end, kind in sorted(places):
        last, first = bisect_left(starts, start), bisect_right(ends, end)
        before = [text[a : min(b, start)].lower() for a, b in words[max(0, last - 2) : last]]
        after = [text[max(a, end) : b].lower() for a, b in words[first : first + 1]]
        at = start - 1
        while at >= 0 and text[at].isspace():
            at -= 1
        sign = text[at] if at >= 0 and text[at] in ":=#" else ""
        patterns = []
        if before:
            patterns.append(f"<{before[-1]}{sign}")
        if len(before) == 2:
            patterns.append(f"<<{before[0]} {before[1]}{sign}")
        if before and after:
            patterns.append(f"<>{before[-1]}{sign}|{after[0]}")
        yield start, end, kind, re.sub(r"\s+", " ", text[start:end].lower()), patterns


def extracted(docs: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each row of docs: row (unique), the columns `keep`, base spans and instances."""
    fields = docs.select(*keep).schema
    spans = "array<struct<start:int,kind:int,end:int>>"
    found = "array<struct<start:int,end:int,kind:int,surface:string,patterns:array<string>>>"

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows, more = [], []
            for text in batch.pop("__text"):
                rows.append(own := base(text))
                more.append([dict(zip(("start", "end", "kind", "surface", "patterns"), x)) for x in instances(text, own)] if own or _hint(text) else [])
            yield batch.assign(row=range(row, row + len(batch)), spans=[[dict(zip(("start", "kind", "end"), x)) for x in own] for own in rows], instances=more)
            row += len(batch)

    out = StructType([*fields, *_parse_datatype_string(f"row long, spans {spans}, instances {found}")])
    return docs.select(*keep, common.whole_text().alias("__text")).mapInPandas(find, out)


def suits(kind: Column, surface: Column) -> Column:
    """Whether a surface has the form of a kind, loosely."""
    digits = F.length(F.regexp_replace(surface, "[^0-9]", ""))
    email = surface.rlike(r"^[^@\s]+@[^@\s]+$")
    ip = surface.rlike(r"^[0-9]{1,3}([.:][0-9]{1,3}){3}$")
    # Java walks a group that repeats without bound by recursion: thousands of digits in a row would overflow a task's stack.
    card = surface.rlike(r"^[0-9]([ .-]?[0-9]){11,18}$")
    phone = surface.rlike(r"^[+(]?[0-9][0-9()./ -]+$") & digits.between(7, 15)
    return F.when(kind == 0, email).when(kind == 1, ip).when(kind == 2, card).otherwise(phone)


def discovered(table: DataFrame) -> DataFrame:
    """(surface, kind) of the instances that the bootstrap accepts beyond the seeds."""
    seen = table.select(F.explode("instances").alias("x")).select("x.surface", "x.kind", F.explode("x.patterns").alias("pattern"))
    edges = common.written(seen.groupBy("pattern", "surface").agg(F.max("kind").alias("seed")), "edges")
    unseen = [F.count(F.when((F.col("seed") < 0) & suits(F.lit(k), F.col("surface")), 1)) for k in range(len(KINDS))]
    size = edges.groupBy("pattern").agg(F.count("*").alias("size"), F.array(*unseen).alias("unseen"))
    known = edges.where("seed >= 0").select("surface", F.col("seed").alias("kind")).distinct().withColumn("confidence", F.lit(1.0))
    seeds = known
    for k in range(ROUNDS):
        support = edges.join(known, "surface").groupBy("pattern", "kind").agg(F.sum("confidence").alias("weight"), F.count("*").alias("support"), F.count(F.when((F.col("seed") < 0) & suits(F.col("kind"), F.col("surface")), 1)).alias("found"))
        confident = support.where(F.col("support") >= MIN_SUPPORT).join(size, "pattern")
        open_ = F.get("unseen", F.col("kind")) - F.col("found")
        among = F.col("size") - (1 - UNSEEN) * open_
        confident = confident.withColumn("confidence", F.col("weight") / (among + SMOOTHING)).where(F.col("confidence") >= PATTERN_CONFIDENCE)
        fresh = edges.where("seed < 0").join(confident.select("pattern", "kind", "confidence"), "pattern")
        fresh = fresh.where(suits(F.col("kind"), F.col("surface"))).groupBy("surface", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("confidence"))
        fresh = fresh.where(F.col("confidence") >= INSTANCE_CONFIDENCE)
        known = common.written(seeds.unionByName(fresh), f"known-{k}")
    best = known.join(seeds.select("surface"), "surface", "left_anti").groupBy("surface").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    return best


def spans(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """For each row of docs: the columns `keep` (doc_id), base and spans (arrays of start, kind number, end), row.

    Positions are code points, ends exclusive; spans hold the base ones and those discovered. Null texts count as empty,
    long ones are read whole, as are long instances. Rows are kept one by one, repeated ones too; an empty table gives no
    row. Of kinds equally sure for a surface the first counts. The names in `keep` must be other than row, base, spans,
    instances, more and __text.
    """
    keep = ["doc_id"] if keep is None else keep
    table = common.written(extracted(docs, keep), "identifiers", common.TEXT_ROWS)
    unseen = F.filter("instances", lambda x: x["kind"] < 0)
    found = table.select("row", F.explode(unseen).alias("x")).select("row", "x.start", "x.end", "x.surface")
    more = found.join(discovered(table), "surface").groupBy("row").agg(F.collect_set(F.struct(F.col("start"), F.col("kind"), F.col("end"))).alias("more"))
    # Only rows with something to discover take part in the join; the others don't move.
    able = F.size(unseen) > 0
    joined = table.where(able).join(more, "row", "left")
    both = F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", "more")))
    out = joined.select(*keep, "row", F.col("spans").alias("base"), both.alias("spans"))
    return out.unionByName(table.where(~able).select(*keep, "row", F.col("spans").alias("base"), "spans"))


def listed(column: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def counted(column: str, kind: int) -> Column:
    return F.size(F.filter(column, lambda x: x["kind"] == kind)).cast("long")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_discovered."""
    found = spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    counts = [counted("base", k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_discovered"))


def masked(docs: DataFrame) -> DataFrame:
    """docs with every span of `text` replaced by its kind in angle brackets; overlapping spans become one, of the first kind.

    Null texts stay null.
    """
    keep = [f"c{k}" for k in range(len(docs.columns))]
    named = docs.select(*[common.named(c).alias(k) for c, k in zip(docs.columns, keep)], F.col("text"))
    at = docs.columns.index("text")
    found = spans(named, keep)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for text, own in zip(batch[f"c{at}"], batch["spans"]):
                if text is not None and len(own):
                    parts, end = [], 0
                    for x in own:
                        if x["start"] >= end:
                            parts += [text[end : x["start"]], MASK[KINDS[x["kind"]]]]
                        end = max(end, x["end"])
                    text = "".join([*parts, text[end:]])
                texts.append(text)
            yield batch.assign(**{f"c{at}": texts})[keep]

    rows = found.where(F.size("spans") > 0).select(*keep, "spans").mapInPandas(cut, found.select(*keep).schema)
    return found.where(F.size("spans") == 0).select(*keep).unionByName(rows).toDF(*docs.columns)
