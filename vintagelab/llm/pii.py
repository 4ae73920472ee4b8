"""Operator 5, personal data: base patterns and bootstrapped contextual extraction, in DataFrame functions alone.

Base matches are the seeds. The one and two words at either side of a seed are lexical patterns. Wherever such a pattern stands in
the corpus, the token beside it is an instance; patterns and instances make a graph: a pattern is as good as the instances that
it picks, an instance as good as its patterns together. After a few rounds, patterns of high confidence add the instances at
which they stand, of whatever form, as long as they aren't plain words in small letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import no_clash, positional, staged, text_or_empty

#: The base patterns, so written that each starts where a run starts or the last match ended, and never backtracks.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "context")
OCTET = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]?)"
#: Rounds over the graph; distinct seeds that a pattern needs; share of a pattern's places that must be seeds for it to be looked
#: at; confidence from which it adds instances.
ROUNDS, LEAST_SEEDS, LEAST_SHARE, CONFIDENCE = 3, 3, 0.25, 0.5
#: Seeded patterns that are broadcast at most; where there are more, the corpus's words are counted first and then joined.
BROADCAST_PATTERNS = 100_000
#: A word that is no identifier by itself.
PLAIN = r"^[a-zß-öø-ÿ]*+$"
#: Elements of an array that are worked through at a time, so that the growing results are copied in parts.
CHUNK = 128

_SPAN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def bound(value: Column, use) -> Column:
    """use(value), the value being computed once, however often and in whatever lambda it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scanned(items: Column, kind: str, step) -> Column:
    """The array of step(at, item)'s second values, `at` being 0 and then its first value for the item before; items is a column
    or a bound value."""
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int"))), lambda k: F.slice(items, k * CHUNK + 1, F.lit(CHUNK)))

    def one(acc, x):
        at, out = step(acc["at"], x)
        return F.struct(at.cast("int").alias("at"), F.array_append(acc["out"], out).alias("out"))

    def chunk(acc, c):
        start = F.struct(acc["at"].alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(c, start, one, lambda a: F.struct(a["at"].alias("at"), F.array_append(acc["out"], a["out"]).alias("out")))

    return F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out")), chunk, lambda acc: F.flatten(acc["out"]))


def spaced(text: Column) -> Column:
    """The text with each white space a blank, of equal length."""
    return F.translate(text, "\n\t\r", "   ")


def matches(text: Column, regex: str, guard: Column) -> Column:
    """The regex's leftmost matches as (start, end, value, before, after) in code points: what is between them and they give the
    places; before and after are the texts to the neighbouring matches."""
    gaps, found = F.split(text, regex, -1), F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    parts = F.arrays_zip(gaps.alias("before"), found.alias("value"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("after"))
    parts = F.filter(parts, lambda x: x["value"].isNotNull())
    ends = lambda parts: scanned(parts, "int", lambda at, x: (at + F.length(x["before"]) + F.length(x["value"]),) * 2)
    spans = bound(parts, lambda parts: F.zip_with(parts, ends(parts), lambda x, end: F.struct((end - F.length(x["value"])).alias("start"), end.alias("end"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after"))))
    return F.when(guard, spans).otherwise(F.array().cast(_SPAN))


def luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    back = F.reverse(digits)

    def step(total, i):
        d = F.ascii(F.substring(back, i, F.lit(1))) - 48
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def with_base(df: DataFrame, text_col: str) -> DataFrame:
    """df with _email, _ip, _card and _phone: arrays of (start, end, value, before, after) of the base patterns; no shuffle."""
    text = F.col(text_col)
    digits = lambda x: F.regexp_replace(x["value"], "[^0-9]", "")
    size = lambda x, least, most: F.length(digits(x)).between(least, most)
    return (
        df.withColumn("_email", matches(text, EMAIL, F.instr(text, "@") > 0))
        .withColumn("_ip", F.filter(matches(text, IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]")), lambda x: x["value"].rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")))
        .withColumn("_card", F.filter(matches(text, CARD, text.rlike("(?:[0-9][ -]?){13}")), lambda x: F.when(size(x, 13, 19), luhn(digits(x))).otherwise(False)))
        .withColumn("_phone", F.filter(matches(text, PHONE, F.instr(text, "+") > 0), lambda x: size(x, 9, 15)))
    )


def base_spans() -> Column:
    """The base spans as (rank of the kind, start, end), by kind and then start."""

    def ranked(i: int, kind: str) -> Column:
        return F.transform(f"_{kind}", lambda x: F.struct(F.lit(i).alias("rank"), x["start"].alias("start"), x["end"].alias("end")))

    return F.concat(*[ranked(i, k) for i, k in enumerate(KINDS[:4])])


def label(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def sides(x: Column) -> Column:
    """The patterns of a base match, as (side, key): one and two whole words before and after it, in small letters."""
    flat = lambda c: F.lower(F.regexp_replace(spaced(x[c]), " ++", " "))
    before, after = flat("before"), flat("after")
    # What is glued to the match belongs to its own token.
    before = F.rtrim(F.substring(before, F.lit(1), F.length(before) - F.length(F.substring_index(before, " ", -1))))
    after = F.ltrim(F.substring(after, F.length(F.substring_index(after, " ", 1)) + 1, F.length(after)))
    made = [("L", "1 ", F.substring_index(before, " ", -1)), ("L", "2 ", F.substring_index(before, " ", -2)), ("R", "1 ", F.substring_index(after, " ", 1)), ("R", "2 ", F.substring_index(after, " ", 2))]
    all_four = F.array(*[F.struct(F.lit(side).alias("side"), F.concat(F.lit(order), words).alias("key"), words.alias("words")) for side, order, words in made])
    return F.filter(all_four, lambda p: F.when(F.startswith(p["key"], F.lit("1 ")), p["words"] != "").otherwise(F.instr(F.trim(p["words"]), " ") > 0))


def corpus_keys(docs: DataFrame, *kept: str) -> DataFrame:
    """(kept, key) for each word and each two words in a row of _text."""
    words = docs.select(*kept, F.filter(F.split(F.lower(spaced(F.col("_text"))), " "), lambda w: w != "").alias("w"))
    pairs = F.zip_with("w", F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.concat(F.lit("2 "), a, F.lit(" "), b))
    both = F.concat(F.transform("w", lambda w: F.concat(F.lit("1 "), w)), F.filter(pairs, lambda p: p.isNotNull()))
    return words.select(*kept, F.explode(both).alias("key"))


def strong_patterns(found: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(seeds: side, key, token; patterns: side, key) of the patterns with LEAST_SEEDS distinct seeds, which stand at seeds in
    LEAST_SHARE of their places; None if there are none. Everything is counted before it is joined."""
    each = found.select(F.explode(F.concat(*[F.transform(f"_{k}", lambda x: F.struct(x["value"].alias("token"), x["sides"].alias("sides"))) for k in KINDS[:4]])).alias("x"))
    each = each.select(F.lower("x.token").alias("token"), F.explode("x.sides").alias("p")).groupBy("p.side", "p.key", "token").agg(F.count(F.lit(1)).alias("n"))
    each = staged(each, "pii-seeds")
    seeded = staged(each.groupBy("side", "key").agg(F.count(F.lit(1)).alias("seeds"), F.sum("n").alias("n")).where(F.col("seeds") >= LEAST_SEEDS), "pii-seeded")
    some = seeded.select("key").distinct()
    n = some.count()
    if not n:
        return None
    if n <= BROADCAST_PATTERNS:
        counts = corpus_keys(docs).join(F.broadcast(some), "key").groupBy("key").agg(F.count(F.lit(1)).alias("everywhere"))
    else:
        counts = corpus_keys(docs).groupBy("key").agg(F.count(F.lit(1)).alias("everywhere")).join(some, "key")
    strong = staged(seeded.join(counts, "key").where(F.col("n") >= LEAST_SHARE * F.col("everywhere")).select("side", "key"), "pii-strong")
    if strong.isEmpty():
        return None
    return each.join(strong, ["side", "key"]).select("side", "key", "token"), strong


def instances(docs: DataFrame, strong: DataFrame) -> DataFrame:
    """(_row, start, end, token, side, key) of the tokens outside base spans beside a strong pattern; docs: _row, _text, base.

    Texts in which no strong pattern stands are left out first; in the others each token gets its place."""
    one = strong.select("key").distinct()
    rows = corpus_keys(docs, "_row").join(one, "key").select("_row").distinct()
    some = docs.join(rows, "_row").withColumn("parts", F.split(spaced(F.col("_text")), " "))
    ends = scanned(F.col("parts"), "int", lambda at, x: (at + F.length(x) + 1, at + F.length(x)))
    tokens = F.filter(F.zip_with("parts", ends, lambda p, e: F.struct(p.alias("part"), e.alias("end"), F.lower(p).alias("word"))), lambda t: t["part"] != "")
    some = some.select("_row", "base", tokens.alias("t"), F.size(tokens).alias("n"))
    word = lambda i: F.when((i >= 1) & (i <= F.col("n")), F.try_element_at("t", i)["word"])
    near = F.transform(F.col("t"), lambda x, i: F.struct(x["part"].alias("part"), x["end"].alias("end"), word(i - 1).alias("l2"), word(i).alias("l1"), word(i + 2).alias("r1"), word(i + 3).alias("r2")))
    some = some.select("_row", "base", F.explode(near).alias("x")).select("_row", "base", "x.*")
    two = lambda a, b: F.concat(F.lit("2 "), F.col(a), F.lit(" "), F.col(b))
    made = [("L", F.concat(F.lit("1 "), F.col("l1"))), ("L", two("l2", "l1")), ("R", F.concat(F.lit("1 "), F.col("r1"))), ("R", two("r1", "r2"))]
    some = some.select("_row", "base", "part", "end", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), k.alias("key")) for s, k in made])).alias("p"))
    some = some.select("_row", "base", "part", "end", "p.side", "p.key").join(strong, ["side", "key"])
    head = F.regexp_replace("part", "^[^A-Za-z0-9À-ɏ+@]++", "")
    start = F.col("end") - F.length(head)
    token = F.regexp_replace(head, "(?<=[A-Za-z0-9À-ɏ])[^A-Za-z0-9À-ɏ]++$", "")
    some = some.select("_row", "base", start.alias("start"), (start + F.length(token)).alias("end"), token.alias("token"), "side", "key").where("token <> ''")
    return some.where(~F.exists("base", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start")))).drop("base")


def confident(stands: DataFrame, seeds: DataFrame) -> DataFrame:
    """(side, key, confidence) of the patterns that pass, from instances (side, key, token) and seeds (side, key, token).

    A pattern's confidence is the score of its distinct instances over their number and one; a seed's score is one, a plain
    word's zero, another instance's what its patterns leave no doubt of. Edges are counted first, so each is one row."""
    edges = stands.select("side", "key", F.lower("token").alias("token"), F.lit(0).alias("seed"), (~F.col("token").rlike(PLAIN)).cast("int").alias("apt"))
    edges = edges.union(seeds.select("side", "key", "token", F.lit(1), F.lit(1)))
    edges = staged(edges.groupBy("side", "key", "token").agg(F.max("seed").alias("seed"), F.max("apt").alias("apt")), "pii-edges")
    score = edges.groupBy("token").agg(F.max("seed").cast("double").alias("score"))
    for _ in range(ROUNDS):
        rated = edges.join(score, "token").groupBy("side", "key").agg((F.sum("score") / (F.count(F.lit(1)) + 1)).alias("confidence"))
        rated = staged(rated, "pii-rated")
        doubt = edges.join(rated, ["side", "key"]).groupBy("token").agg(F.max("seed").alias("seed"), F.max("apt").alias("apt"), F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999)))).alias("doubt"))
        score = staged(doubt.select("token", F.when(F.col("seed") == 1, 1.0).when(F.col("apt") == 0, 0.0).otherwise(1 - F.exp("doubt")).alias("score")), "pii-scores")
    return rated.where(F.col("confidence") >= CONFIDENCE)


OWN = [*(f"n_{k}" for k in KINDS[:4]), "base", "spans"]


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every document with its personal data: the columns keep (by default the id), n_email, n_ip, n_card, n_phone, and two
    arrays of (rank of the kind, start, end): base, by kind and start, and spans, the base ones and those of the context.

    Places are in code points, end exclusive. A null text is empty; null and repeated ids and repeated rows each give a row; an
    empty table gives none; columns besides keep and the text aren't read; a kept column with the name of a result's column is an
    error that says so. A text of any length is a row of its own, so one task holds it, as any expression does.
    """
    keep = keep or [id_col]
    no_clash(keep, OWN)
    kept = positional(df.select(*[F.col(c) for c in keep], F.col(text_col))).withColumnRenamed(f"_k{len(keep)}", "_text")
    return _extracted(kept).select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], *OWN)


def _extracted(kept: DataFrame) -> DataFrame:
    """personal_data() of _k0, _k1, ... and _text; all of them stay."""
    held = [c for c in kept.columns if c != "_text"]
    docs = kept.withColumn("_row", F.monotonically_increasing_id()).withColumn("_text", text_or_empty("_text"))
    found = with_base(docs, "_text").withColumn("base", base_spans())
    seeds = [F.transform(f"_{k}", lambda x: F.struct(x["value"].alias("value"), sides(x).alias("sides"))).alias(f"_{k}") for k in KINDS[:4]]
    found = staged(found.select("_row", *held, "_text", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:4]], "base", *seeds), "pii-found")
    plain = found.drop(*[f"_{k}" for k in KINDS[:4]])
    if (strong := strong_patterns(found, found.select("_text"))) is None:
        return plain.withColumn("spans", F.col("base"))
    stands = staged(instances(found.select("_row", "_text", "base"), strong[1]), "pii-instances")
    good = confident(stands, strong[0])
    added = stands.where(~F.col("token").rlike(PLAIN)).join(good, ["side", "key"]).select("_row", "start", "end").distinct()
    added = staged(added.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(F.lit(4).alias("rank"), "start", "end"))).alias("more")), "pii-added")
    # Few rows gain any: where they are small, Spark sends them to the others, which then stay where they are.
    more = F.coalesce("more", F.array().cast("array<struct<rank:int,start:int,end:int>>"))
    return plain.join(added, "_row", "left").withColumn("spans", F.concat("base", more)).drop("more")


def redacted(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with its personal data replaced by [EMAIL], [IP], [CARD], [PHONE] or [ID]; overlapping spans become the first one's
    mark; all columns stay, whatever their names; a null text stays null; null ids and repeated rows each stay; an empty table stays
    empty. A text of any length is a row of its own, cut in parts of CHUNK spans."""
    names = F.array(*[F.lit(f"[{k}]") for k in ("EMAIL", "IP", "CARD", "PHONE", "ID")])
    at, text = df.columns.index(text_col), F.col("_text")
    found = _extracted(positional(df).withColumn("_text", F.col(f"_k{at}")))
    spans = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))))
    since = lambda spans: scanned(spans, "int", lambda at, s: (F.greatest(at, s["end"]), at))
    marked = bound(spans, lambda spans: F.zip_with(spans, since(spans), lambda s, a: F.struct(a.alias("from"), s["start"].alias("to"), F.get(names, s["rank"]).alias("mark"))))
    marked = F.filter(marked, lambda s: s["to"] >= s["from"])
    # Each chunk of spans is cut from its own part of the text, as a place in a text is found from its beginning.
    cut = lambda part, at, s: F.concat(F.substring(part, s["from"] - at + 1, s["to"] - s["from"]), s["mark"])
    part = lambda c: F.struct(F.get(c, F.lit(0))["from"].alias("at"), F.substring(text, F.get(c, F.lit(0))["from"] + 1, F.element_at(c, -1)["to"] - F.get(c, F.lit(0))["from"]).alias("part"))
    chunk = lambda c: bound(part(c), lambda p: F.transform(c, lambda s: cut(p["part"], p["at"], s)))
    pieces = bound(marked, lambda m: F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / CHUNK).cast("int")), lambda k: bound(F.slice(m, k * CHUNK + 1, F.lit(CHUNK)), chunk))))
    clean = F.concat(F.array_join(pieces, ""), F.substring(text, F.array_max(F.transform("spans", lambda s: s["end"])) + 1, F.length(text)))
    clean = F.when(F.col(f"_k{at}").isNull() | (F.size("spans") == 0), F.col(f"_k{at}")).otherwise(clean)
    return found.select(*[(clean if i == at else F.col(f"_k{i}")).alias(c) for i, c in enumerate(df.columns)])
