"""Dictionary classification of groups, typed entities, merging of adjacent persons, and aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import text as T
from tessera.sources import tables

GROUP = ["doc_id", "pass", "ord"]
MAX_BATCH, DECOY_RATIO = 100, 0.35
MERGE_GAP = 3
#: Documents of a session that are numbered together, and terms that are batched together.
NUMBERED = 10_000
SHARD_TERMS = 100_000
#: Entries that are broadcast at most; a word is heavy beyond one part in so many of a shuffle partition's share.
MOST_ENTRIES, HEAVY = 200_000, 8


def lookup_terms(groups: DataFrame) -> DataFrame:
    """term, jurisdiction-free: the distinct words that classification asks for. Certain groups are not looked up."""
    return groups.where("not skip").select(F.explode("words").alias("term")).distinct()


def real_per_batch(max_batch: int = MAX_BATCH, ratio: float = DECOY_RATIO) -> int:
    """Terms of a lookup batch that leave room for decoys."""
    return max(1, int(max_batch // (1 + ratio)))


def lookup_batches(terms: DataFrame, max_batch: int = MAX_BATCH, ratio: float = DECOY_RATIO, shard: Column | None = None) -> DataFrame:
    """term, shard, batch: terms in batches of bounded size. Shards, of a hash unless given, spread the numbering out.

    Without `shard` there are as many as give each SHARD_TERMS terms.
    """
    size = real_per_batch(max_batch, ratio)
    if shard is None:
        terms = tables.written(terms, "terms")
        shard = F.pmod(F.xxhash64("term"), F.lit(max(1, terms.count() // SHARD_TERMS))).cast("int")
    nth = F.row_number().over(Window.partitionBy("shard").orderBy("term")) - 1
    return terms.withColumn("shard", shard).withColumn("batch", F.floor(nth / size).cast("int"))


def probes(groups: DataFrame) -> DataFrame:
    """groups with at, word: a row for what is looked up of each group, its text (at -1) and its words (from 0)."""
    text = F.array(F.struct(F.lit(-1).alias("at"), F.col("text").alias("word")))
    words = F.transform("words", lambda w, k: F.struct(k.alias("at"), w.alias("word")))
    rows = groups.select("*", F.explode_outer(F.when(~F.col("skip"), F.concat(text, words))).alias("p"))
    return rows.select(*groups.columns, "p.at", "p.word")


def entries_of(dictionary: DataFrame, cache: DataFrame | None, now: Column | None) -> DataFrame:
    """word, dict, entry_type, of (jurisdiction), entry (order), cached: what a term is answered with.

    Terms that the cache holds (term, results: array of dict, type, jurisdiction; expires_at) and that haven't expired are
    answered from it, with dict null where it says that there is nothing; the dictionary answers the others.
    """
    rows = dictionary.where("match").select(F.col("term").alias("word"), "dict", F.col("type").alias("entry_type"), F.col("jurisdiction").alias("of"), F.col("ord").alias("entry"), F.lit(False).alias("cached"))
    if cache is None:
        return rows
    live = cache.where(F.col("expires_at") >= now)
    known = live.select(F.col("term").alias("word"), F.posexplode_outer("results").alias("entry", "r"))
    known = known.select("word", "r.dict", F.col("r.type").alias("entry_type"), F.col("r.jurisdiction").alias("of"), F.coalesce("entry", F.lit(0)).alias("entry"), F.lit(True).alias("cached"))
    return rows.join(live.select(F.col("term").alias("word")), "word", "left_anti").unionByName(known)


def looked_up(each: DataFrame, entries: DataFrame) -> DataFrame:
    """each with the entries of its word, as a left join has them, though a few words may be most of all.

    Words are counted before they move. If few entries are asked for, they go to where the words are, which don't move at
    all. Otherwise that holds for words that are more than 1 / HEAVY of a shuffle partition, a bounded number, and for rows
    without a word; only the rest is shuffled by word.
    """
    spark = each.sparkSession
    counts = tables.written(each.where("word is not null").groupBy("word").agg(F.count("*").alias("n")), "asked")
    hits = tables.written(entries.join(counts, "word", "left_semi"), "hits")
    if hits.count() <= MOST_ENTRIES:
        return each.join(F.broadcast(hits), "word", "left")
    most = HEAVY * int(spark.conf.get("spark.sql.shuffle.partitions"))
    heavy = counts.where(F.col("n") > (counts.agg(F.sum("n")).first()[0] or 0) / most).select("word")
    theirs = hits.join(F.broadcast(heavy), "word", "left_semi")
    if theirs.count() > MOST_ENTRIES:
        return each.join(hits, "word", "left")
    marked = each.join(F.broadcast(heavy.withColumn("heavy", F.lit(True))), "word", "left")
    still = F.col("word").isNull() | F.col("heavy").isNotNull()
    near = marked.where(still).drop("heavy").join(F.broadcast(theirs), "word", "left")
    return near.unionByName(marked.where(~still).drop("heavy").join(hits, "word", "left"))


def classified(groups: DataFrame, dictionary: DataFrame, jurisdictions: DataFrame | None = None, cache: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """groups with evidence (type) and sources, by dictionary (term, dict, match, type, jurisdiction, ord).

    Entries that don't match count for nothing. The type is that of the last entry for the group's whole text, else that
    of the first entry of the first word that has one. A text of several words is never looked up in the dictionary, only
    in the cache; one that the cache holds, with or without entries, keeps its words from being looked up. A group of one
    word names its sources twice. `jurisdictions` (doc_id, jurisdictions array; empty for all) restricts entries.
    """
    each = probes(groups)
    if jurisdictions is not None:
        each = each.join(jurisdictions, "doc_id", "left")
    each = looked_up(each, entries_of(dictionary, cache, now))
    whole = F.col("at") == -1
    asked = ~whole | (F.size("words") == 1) | F.col("cached")
    hit = F.col("dict").isNotNull() & asked
    if jurisdictions is not None:
        hit = hit & (F.col("cached") | F.col("jurisdictions").isNull() | (F.size("jurisdictions") == 0) | F.array_contains("jurisdictions", F.col("of")))
    kept = [c for c in groups.columns if c not in GROUP]
    found = F.struct("at", "entry", "dict")
    out = each.groupBy(*GROUP).agg(
        *[F.first(c).alias(c) for c in kept],
        F.max_by(F.when(hit & whole, F.col("entry_type")), F.when(hit & whole, F.col("entry"))).alias("last"),
        F.min_by(F.when(hit & ~whole, F.col("entry_type")), F.when(hit & ~whole, F.struct("at", "entry"))).alias("lead"),
        F.coalesce(F.max(whole & F.col("cached") & (F.size("words") > 1)), F.lit(False)).alias("short"),
        F.array_sort(F.collect_list(F.when(hit, found))).alias("hits"),
    )
    names = F.transform(F.filter("hits", lambda h: ~F.col("short") | (h["at"] == -1)), lambda h: h["dict"])
    return out.select(*groups.columns, F.coalesce("last", F.when(~F.col("short"), F.col("lead"))).alias("evidence"), names.alias("sources"))


def typed(classified_groups: DataFrame) -> DataFrame:
    """doc_id, pass, ord, text, start, end, tail (the text after it), type, confidence, sources: one entity for each group."""
    local, evidence = F.col("local_type"), F.col("evidence")
    sure = F.when(evidence.isNotNull(), "high").otherwise("medium")
    by_local = F.when(local == "company_candidate", "company").when(local == "person_candidate", "person").when(local == "address_fragment", "address")
    by_evidence = F.when(evidence.isin("first_name", "surname"), "person").when(evidence.isin("city", "commune"), "city").when(evidence == "company", "company")
    kind = F.when(F.col("skip"), local).otherwise(F.coalesce(by_local, by_evidence, F.lit("unknown")))
    confidence = F.when(F.col("skip"), "high").when(by_local.isNotNull(), sure).when(by_evidence.isNotNull(), "medium").otherwise("low")
    sources = F.when(F.col("skip"), F.array(F.concat(F.lit("local:"), local))).when(F.size("sources") == 0, F.array(F.lit("local:candidate"))).otherwise(F.col("sources"))
    return classified_groups.select(*GROUP, "text", "start", "end", "tail", kind.alias("type"), confidence.alias("confidence"), sources.alias("sources"))


def merged(entities: DataFrame) -> DataFrame:
    """entities with pairs of persons at most MERGE_GAP characters apart as one; `merged` marks those.

    A third person in a row stays by itself, with a fourth as the next pair. What stands between two is in `tail`.
    """
    order = Window.partitionBy("doc_id").orderBy("start", "pass", "ord")
    person = F.col("type") == "person"
    joins = person & (F.lag("type").over(order) == "person") & (F.col("start") - F.lag("end").over(order) <= MERGE_GAP)
    rows = entities.withColumn("break", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("break").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("doc_id", "island").orderBy("start", "pass", "ord")
    rows = rows.withColumn("pair", F.floor((F.row_number().over(inside) - 1) / 2))
    member = F.struct("start", "pass", "ord", "end", "text", "tail", "type", "confidence", "sources")
    pairs = rows.groupBy("doc_id", "island", "pair").agg(F.array_sort(F.collect_list(member)).alias("m"))
    a, b = F.get("m", F.lit(0)), F.get("m", F.lit(1))
    two = F.size("m") == 2
    between = F.substring(a["tail"], F.lit(1), F.greatest(b["start"] - a["end"], F.lit(0)))
    return pairs.select(
        "doc_id", a["pass"].alias("pass"), a["ord"].alias("ord"),
        F.when(two, F.concat(a["text"], between, b["text"])).otherwise(a["text"]).alias("text"),
        a["start"].alias("start"), F.when(two, b["end"]).otherwise(a["end"]).alias("end"), a["type"].alias("type"),
        F.when(two, F.when((a["confidence"] == "high") | (b["confidence"] == "high"), "high").otherwise("medium")).otherwise(a["confidence"]).alias("confidence"),
        F.when(two, F.array_distinct(F.concat(a["sources"], b["sources"]))).otherwise(a["sources"]).alias("sources"), two.alias("merged"),
    )


def generic_alias(kind: Column, n: Column) -> Column:
    forms = {
        "person": "Personne %d", "company": "Société %d", "address": "Adresse %d", "city": "Ville %d", "email": "personne%d@exemple.fr",
        "phone": "+33 X XX XX XX X%d", "iban": "FRXX XXXX XXXX XXXX XXXX XXX%d", "ssn": "X XX XX XX XXX XXX X%d", "url": "https://exemple.fr/page%d",
    }
    out = F.format_string("Entité %d", n)
    for name, form in forms.items():
        out = F.when(kind == name, F.format_string(form, n)).otherwise(out)
    return out


def plain(word: Column) -> Column:
    """Lower-case without the accents that the name pools have."""
    return F.translate(F.lower(word), "àâäçéèêëîïôöùûüÿ", "aaaceeeeiioouuuy")


def realistic_alias(kind: Column, text: Column, *of: Column) -> Column:
    """An invented value of the same kind, picked by a hash of `of` and the text: repeated runs give the same one."""
    first, last = L.FIRST_NAMES.split(), L.SURNAMES.split()
    pick = lambda pool, salt: T.picked(pool, *of, text, F.lit(salt))
    number = lambda low, n, salt: (F.pmod(F.xxhash64(*of, text, F.lit(salt)), F.lit(n)) + low).cast("int").cast("string")
    parts = F.size(F.split(text, r"[\s-]+"))
    person = F.when(parts >= 2, F.concat_ws(" ", pick(first, "first"), pick(last, "last"))).when(text == F.upper(text), F.upper(pick(last, "last"))).otherwise(pick(first, "first"))
    form = F.regexp_extract(text, rf"(?i)^({'|'.join(L.KEPT_FORMS.split())})\b", 1)
    company = F.when(form != "", F.concat_ws(" ", form, pick(L.COMPANY_NAMES.split(), "name"))).otherwise(F.concat_ws(" ", pick(L.COMPANY_PREFIXES.split(), "prefix"), pick(L.COMPANY_SUFFIXES.split(), "suffix")))
    address = F.concat_ws(" ", number(1, 150, "number"), pick(L.STREET_KINDS, "kind"), pick(L.STREET_NAMES, "street"))
    email = F.concat(plain(pick(first, "first")), F.lit("."), plain(pick(last, "last")), F.lit("@"), pick(L.MAIL_DOMAINS, "domain"))
    digits = F.array_join(F.transform(F.split(text, ""), lambda c, k: F.when(c.rlike("[0-9]"), F.pmod(F.xxhash64(text, k, F.lit("digit")), F.lit(10)).cast("string")).otherwise(c)), "")
    french = F.concat_ws(" ", F.lit("+33 6"), *[number(10, 90, f"phone{k}") for k in range(4)])
    british = F.concat_ws(" ", F.lit("+44"), *[number(100, 900, f"phone{k}") for k in range(3)])
    phone = F.when(text.rlike(r"^(\+33|0[1-9])"), french).when(text.startswith("+44"), british).otherwise(digits)
    url = F.concat(F.when(text.startswith("https"), "https").otherwise("http"), F.lit("://"), pick(L.URL_DOMAINS, "domain"), F.lit("/"), pick(L.URL_PATHS, "path"))
    return (
        F.when(kind == "person", person).when(kind == "company", company).when(kind == "address", address).when(kind == "city", pick(L.CITIES.split(), "city"))
        .when(kind == "email", email).when(kind == "phone", phone).when(kind == "url", url).when(kind.isin("iban", "ssn"), T.masked(text))
        .otherwise(F.concat(F.lit("["), F.substring(text, 1, 3), F.lit("...]")))
    )


def requests(entities: DataFrame, final: DataFrame, sessions: DataFrame) -> DataFrame:
    """session_id, text, type, seq: what asks for an alias, in order. Groups of a document come before its merged persons."""
    ask = lambda rows, phase: rows.select("doc_id", "text", "type", F.lit(phase).alias("phase"), "pass", "ord", "start")
    asked = ask(entities, 0).unionByName(ask(final.where("merged").withColumn("pass", F.lit(0)), 1)).join(sessions, "doc_id")
    return asked.select("session_id", "text", "type", F.struct("doc_ord", "phase", "pass", "ord", "doc_id").alias("seq"))


def numbered(asked: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """session_id, original, type, n: texts of a session in the order of their first use, numbered by type from 1.

    Texts of `known` (session_id, original) keep their alias and take no number. Documents of a session are numbered in
    parts, whose sizes then add up, so that one long session is many tasks.
    """
    first = asked.groupBy("session_id", F.col("text").alias("original")).agg(F.min_by("type", "seq").alias("type"), F.min("seq").alias("seq"))
    if known is not None:
        first = first.join(known.select("session_id", "original"), ["session_id", "original"], "left_anti")
    first = first.withColumn("part", F.floor(F.col("seq.doc_ord") / NUMBERED))
    sizes = first.groupBy("session_id", "type", "part").agg(F.count("*").alias("size"))
    before = Window.partitionBy("session_id", "type").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    inside = Window.partitionBy("session_id", "type", "part").orderBy("seq", "original")
    rows = first.withColumn("within", F.row_number().over(inside)).join(sizes, ["session_id", "type", "part"])
    return rows.select("session_id", "original", "type", (F.col("within") + F.col("before")).cast("int").alias("n"))


def alias_map(asked: DataFrame, style: str = "generic", known: DataFrame | None = None) -> DataFrame:
    """session_id, original, alias, type of everything asked for; known (session_id, original, alias) wins, empty aliases aside."""
    if known is not None:
        known = known.where("alias is not null and alias <> ''")
    rows = numbered(asked, known)
    if style == "generic":
        alias = generic_alias(F.col("type"), F.col("n"))
    else:
        alias = realistic_alias(F.col("type"), F.col("original"), F.col("session_id").cast("string"))
    rows = rows.select("session_id", "original", alias.alias("alias"), "type")
    if known is None:
        return rows
    kinds = asked.groupBy("session_id", F.col("text").alias("original")).agg(F.min_by("type", "seq").alias("type"))
    return rows.unionByName(known.join(kinds, ["session_id", "original"], "left").select("session_id", "original", "alias", "type"))


def with_aliases(final: DataFrame, sessions: DataFrame, aliases: DataFrame) -> DataFrame:
    """final with session_id and alias."""
    rows = final.join(sessions.select("doc_id", "session_id"), "doc_id")
    return rows.join(aliases.select("session_id", F.col("original").alias("text"), "alias"), ["session_id", "text"])
