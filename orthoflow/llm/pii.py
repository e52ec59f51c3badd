"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Base patterns give the seeds. Every base span, and every identifier-like token
beside them (one with a digit or an @, digits also over spaces), is an occurrence
of an instance, its value, in lexical patterns: the word before, the word after,
and both. They know nothing of the value's form; only a coarse check of its
characters and number of digits says of which kinds it may be. Rounds over the
graph of patterns and instances score a pattern by the trust in its instances and
an instance by its trusted patterns; patterns of high confidence then find
identifiers that no base pattern matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthoflow.llm.scratch import attach, fresh, stored
from orthoflow.llm.textspans import clear_of, count_kind, joined, nothing, replaced, spans

KINDS = ("email", "ip", "card", "phone")
#: A match may start at the start of a run of its characters or where the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Identifier-like tokens, from their first to their last letter or digit.
CANDIDATE = r"(?<![A-Za-z0-9+_%@/.-])[A-Za-z+_%/.-]*+[0-9@](?:[A-Za-z0-9._%+@:/-]*[A-Za-z0-9])?"
#: Groups of digits over spaces and brackets.
SPACED = r"(?<![A-Za-z0-9+_%@/.(-])[+(]{0,2}[0-9]++(?:[\x20()./-]{1,3}+[0-9]++){1,5}+(?![A-Za-z0-9_@%])(?!\.[A-Za-z0-9])"
#: Stands for the characters of base spans where tokens are looked for.
FILLER = "\ue000"

ROUNDS = 3
#: Trust from which a pattern is followed, and from which it extracts; and seeds that it must have.
FOLLOW, EXTRACT, SEEDS = 0.7, 0.9, 5


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a text of digits has a right Luhn check digit."""
    at = F.sequence(F.lit(1), F.length(digits))

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 0, d * 2).otherwise(d)
        return acc + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(at, F.lit(0), step) % 10 == 0


def _octet(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(short) <= 3) & (F.substring(short, 1, 3).cast("int") <= 255)


def _sized(x: Column, low: int, high: int) -> Column:
    return F.length(_digits(x)).between(low, high)


def base_spans(text: Column) -> Column:
    """The spans of all base patterns, by start, then by kind as listed. text is not null."""
    dot, plus = F.contains(text, F.lit(".")), F.contains(text, F.lit("+"))
    email = spans(text, EMAIL, "email", 0, F.contains(text, F.lit("@")))
    ip = F.filter(spans(text, IP, "ip", 1, dot), lambda s: F.forall(F.split(s["value"], r"\."), _octet))
    long = F.filter(spans(text, CARD, "card", 2, text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")), lambda s: _sized(s["value"], 14, 19))
    card = F.filter(long, lambda s: luhn(_digits(s["value"])))
    phone = F.filter(spans(text, PHONE, "phone", 3, plus), lambda s: _sized(s["value"], 10, 15))
    return F.array_sort(F.concat(email, ip, card, phone))


def coarse(value: Column) -> Column:
    """The kinds that a value of any form may be, by its characters and its number of digits."""
    n = F.length(_digits(value))
    plain = value.rlike(r"^[+(]*[0-9][0-9\x20()./-]*$")
    checks = {
        "email": value.rlike("[^@]@[^@]"),
        "ip": value.rlike(r"^[0-9A-Fa-f.:]+$") & (F.length(value) - F.length(F.regexp_replace(value, "[.:]", "")) >= 3),
        "card": plain & n.between(12, 19),
        "phone": plain & n.between(7, 15),
    }
    return F.array_compact(F.array(*[F.when(ok, F.lit(k)) for k, ok in checks.items()]))


def _hidden(text: Column, base: Column) -> Column:
    """text with a filler for each character of a base span, so that places stay."""
    return replaced(text, base, lambda s, at: F.repeat(F.lit(FILLER), F.greatest(s["end"] - F.greatest(at, s["start"]), F.lit(0))))


def occurrences(docs: DataFrame) -> DataFrame:
    """Base spans and identifier-like tokens beside them: doc_id, text_hash, start, end, value, label, kinds, patterns.

    label is the kind of a base span, null for a token; kinds are those that the value may be.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), text.alias("t")).where(F.col("t").rlike("[0-9@]"))
    found = found.select("doc_id", "text_hash", "t", base_spans(F.col("t")).alias("base"))
    found = found.select("doc_id", "text_hash", "base", _hidden(F.col("t"), F.col("base")).alias("t"))
    found = found.select("doc_id", "text_hash", "base", "t", spans(F.col("t"), SPACED, "", 9, F.lit(True)).alias("spaced"))
    found = found.withColumn("spaced", F.filter("spaced", lambda s: _sized(s["value"], 7, 19)))
    found = found.withColumn("whole", spans(F.col("t"), CANDIDATE, "", 9, F.lit(True)))
    one = found.select("doc_id", "text_hash", F.explode(F.concat("base", "spaced", clear_of(F.col("whole"), F.col("spaced")))).alias("c"))
    label = F.when(F.col("c.kind") != "", F.col("c.kind"))
    left = F.lower(F.regexp_extract("c.left", r"(?<!\S)(\S++)[^\S\n]*+$", 1))
    right = F.lower(F.regexp_extract("c.right", r"^[^\S\n]*+(\S++)", 1))
    word = lambda x: F.when((x != "") & ~F.contains(x, F.lit(FILLER)), x)
    rows = one.select("doc_id", "text_hash", "c", label.alias("label"), word(left).alias("l"), word(right).alias("r"))
    patterns = F.array(
        F.concat(F.lit("before\t"), F.col("l")), F.concat(F.lit("after\t"), F.col("r")), F.concat(F.lit("both\t"), F.col("l"), F.lit("\t"), F.col("r"))
    )
    may = coarse(F.col("c.value"))
    return rows.select(
        "doc_id",
        "text_hash",
        F.col("c.start").alias("start"),
        F.col("c.end").alias("end"),
        F.col("c.value").alias("value"),
        "label",
        F.when(F.col("label").isNull(), may).otherwise(F.array_union(F.array("label"), may)).alias("kinds"),
        F.array_compact(patterns).alias("patterns"),
    ).where(F.size("kinds") > 0)


def _by_key(df: DataFrame, key: str, size: str, *columns: str) -> DataFrame:
    """One row for each key: its kinds with their columns as an array, and the largest size."""
    return df.groupBy(key).agg(F.collect_list(F.struct("kind", *columns)).alias("best"), F.max(size).alias(size))


def _fitting(df: DataFrame) -> DataFrame:
    """A row for each kind in best that the value may be."""
    return df.withColumn("b", F.explode(F.filter("best", lambda b: F.array_contains("kinds", b["kind"])))).drop("best")


def score_patterns(found: DataFrame, rounds: int = ROUNDS, follow: float = FOLLOW, seeds: int = SEEDS) -> DataFrame:
    """Patterns worth following: pattern, kind, trust, uses.

    A pattern's trust in a kind is the mean trust of those of its instances that
    may be of that kind; it needs so many instances that are seeds or trusted.
    Seeds have trust 1 in their own kind; other instances take the noisy-or of
    their followed patterns, without those that hold a word of the pattern scored.
    """
    each = found.select("value", "label", "kinds", F.explode("patterns").alias("pattern"))
    edges = each.groupBy("pattern", "value").agg(F.max("label").alias("label"), F.max("kinds").alias("kinds"), F.count(F.lit(1)).alias("uses"))
    edges = stored(edges, "pattern-edges")
    size = edges.select("pattern", F.explode("kinds").alias("kind"), "uses").groupBy("pattern", "kind")
    size = stored(size.agg(F.count(F.lit(1)).alias("instances"), F.sum("uses").alias("uses")), "pattern-sizes")
    trust = edges.where("label is not null").select("pattern", F.col("label").alias("kind"), F.lit(1.0).alias("trust"))
    seeded = stored(trust.groupBy("pattern", "kind").agg(F.sum("trust").alias("given"), F.count(F.lit(1)).alias("backed")), "seeded")
    given, kept = seeded, None
    unknown = edges.where("label is null").select("pattern", "value", "kinds")
    for _ in range(rounds):
        scored = given.join(size, ["pattern", "kind"]).select(
            "pattern", "kind", (F.col("given") / F.col("instances")).alias("trust"), "backed", "uses", "instances"
        )
        kept = stored(scored.where((F.col("trust") >= follow) & (F.col("backed") >= seeds)), "patterns")
        by_pattern = stored(_by_key(kept, "pattern", "instances", "trust"), "best-kinds")
        doubt = F.log(1 - F.least(F.col("b.trust"), F.lit(0.99)))
        side = F.substring_index("pattern", "\t", 1)
        held = _fitting(attach(unknown, by_pattern, "pattern", "instances")).select(
            "pattern", "value", F.col("b.kind").alias("kind"), side.alias("side"), doubt.alias("doubt")
        )
        held = stored(held, "doubts")
        sums = [F.sum(F.when(F.col("side") == k, F.col("doubt")).otherwise(0.0)).alias(k) for k in ("before", "after", "both")]
        instances = stored(_by_key(held.groupBy("value", "kind").agg(*sums, F.count(F.lit(1)).alias("n")), "value", "n", "before", "after", "both"), "instances")
        if instances.isEmpty():
            break
        # a pattern cannot back itself, nor can one with its word
        own = held.select("pattern", "value", "kind", "doubt")
        gained = _fitting(attach(unknown, instances, "value", "n")).select("pattern", "value", F.col("b.kind").alias("kind"), "b")
        gained = gained.join(own, ["pattern", "value", "kind"], "left")
        others = F.when(side == "both", F.col("b.both")).otherwise(F.col("b.before") + F.col("b.after"))
        gained = gained.withColumn("trust", 1 - F.exp(F.least(others - F.coalesce("doubt", F.lit(0.0)), F.lit(0.0))))
        gained = gained.groupBy("pattern", "kind").agg(F.sum("trust").alias("given"), F.count_if(F.col("trust") >= follow).alias("backed"))
        given = stored(
            seeded.unionByName(gained).groupBy("pattern", "kind").agg(F.sum("given").alias("given"), F.sum("backed").alias("backed")), "given"
        )
    return kept.select("pattern", "kind", "trust", "uses")


def discovered(docs: DataFrame, extract: float = EXTRACT) -> DataFrame:
    """Identifiers that trusted patterns find beside the base spans: doc_id, text_hash, extra."""
    found = stored(occurrences(docs), "occurrences")
    patterns = score_patterns(found).where(F.col("trust") >= extract)
    patterns = stored(_by_key(patterns, "pattern", "uses", "trust"), "trusted-patterns")
    new = found.where("label is null").select("doc_id", "text_hash", "start", "end", "kinds", F.explode("patterns").alias("pattern"))
    best = _fitting(attach(new, patterns, "pattern", "uses")).groupBy("doc_id", "text_hash", "start", "end").agg(
        F.max(F.struct("b.trust", "b.kind"))["kind"].alias("kind")
    )
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KINDS)])
    empty = F.lit("")
    span = F.struct("start", rank.alias("rank"), "end", "kind", empty.alias("value"), empty.alias("left"), empty.alias("right"))
    return best.groupBy("doc_id", "text_hash").agg(F.collect_set(span).alias("extra"))


def _with_spans(docs: DataFrame, rows: DataFrame, text_hash: str, found: str, base: str) -> DataFrame:
    """rows of docs, which have doc_id, text_hash and base (those of base patterns), with all spans in found."""
    extra_id, extra_hash, extra = (fresh(rows, x) for x in ("_extra_id", "_extra_hash", "_extra"))
    more = discovered(docs).toDF(extra_id, extra_hash, extra)
    same = rows["doc_id"].eqNullSafe(more[extra_id]) & (rows[text_hash] == more[extra_hash])
    rows = rows.join(more, same, "left").withColumn(extra, F.coalesce(extra, nothing()))
    return rows.withColumn(found, F.array_sort(F.concat(base, clear_of(F.col(extra), F.col(base))))).drop(extra_id, extra_hash, extra, text_hash)


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, found (all spans), base (those of base patterns).

    Spans hold start, end, kind and value, by start, then kind as listed. Null
    texts are empty. Discovered spans never overlap base ones. Rows that repeat
    id and text get equal results; further columns are ignored. An empty table
    gives an empty result; texts are read whole, however long.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # texts are not carried through the join
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), base_spans(text).alias("base"))
    return _with_spans(docs, rows, "text_hash", "found", "base").select("doc_id", "found", "base")


def report(rows: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans."""
    counts = [count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[{kind}]") -> DataFrame:
    """docs with a column `redacted`: each span's text replaced by its kind's mark.

    Each row is redacted by its own spans, also if its id is null or stands for
    several texts. Of overlapping spans the first one is replaced and of the rest
    what lies behind it. Null texts are empty; a column `redacted` of docs is
    replaced.
    """
    docs = docs.drop("redacted")
    found, base, text_hash = fresh(docs, "_found"), fresh(docs, "_base"), fresh(docs, "_hash")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = _with_spans(docs, docs.withColumns({base: base_spans(text), text_hash: F.xxhash64("text")}), text_hash, found, base)
    before, after = mark.split("{kind}")

    # a span that starts inside an earlier one leaves no mark
    marked = lambda s, at: F.when(s["start"] < at, "").otherwise(F.concat(F.lit(before), s["kind"], F.lit(after)))
    return rows.withColumn("redacted", replaced(text, F.col(found), marked)).drop(found, base)
