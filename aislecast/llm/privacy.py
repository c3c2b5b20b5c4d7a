"""Sanitising personal data, with DataFrame expressions alone.

Identifiers of fixed form (e-mail, IP, payment card, phone) are found by
pattern. Which other words give an identifier away is measured on the corpus:
the information a word carries about an identifier is their pointwise mutual
information, and its share in the identifier's own information content is the
word's disclosure. Words of high disclosure are generalised or removed in the
documents that hold the identifier.

The unit of evidence is the distinct line, so copies of a text count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spreading import salted_join
from ..session import written
from .text import with_columns

# The patterns in a form whose search is linear and does not recurse. A run of
# characters is never entered in its middle, but where a match has just ended (\G).
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# A quick look that spares most texts the search.
_HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){15}", "phone": r"\+[0-9]"}
KINDS = (*PATTERNS, "term")
TERM = r"\p{L}[\p{L}\p{N}]{2,}+"
_AROUND = r"[\p{L}\p{N}]"

DISCLOSURE = 0.9
REMOVAL = 0.99
EVIDENCE = 2


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits, 16 to 19 of them, pass the Luhn check."""
    digits = F.reverse(_digits(value))

    def part(i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(i % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    parts = F.transform(F.sequence(F.lit(1), F.length(digits)), part)
    total = F.aggregate(parts, F.lit(0), lambda a, x: a + x)
    return F.when(F.length(digits).between(16, 19), total % 10 == 0).otherwise(False)


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _cut(text: Column, pattern: Column) -> tuple[Column, Column]:
    """The matches of a pattern, and the pieces of text around them (one more)."""
    return F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)


def matches(text: Column, pattern: Column, kind: str) -> Column:
    """Array of (kind, start, end, value) of the matches, in code points."""
    found, pieces = _cut(text, pattern)
    pairs = F.zip_with(pieces, found, lambda piece, value: F.struct(piece.alias("piece"), value.alias("value")))
    span = "struct<kind:string,start:bigint,end:bigint,value:string>"
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{span}>").alias("spans"))

    def add(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["piece"])
        end = begin + F.coalesce(F.length(pair["value"]), F.lit(0))
        one = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), pair["value"].alias("value"))
        spans = F.when(pair["value"].isNull(), state["spans"]).otherwise(F.concat(state["spans"], F.array(one.cast(span))))
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(pairs, start, add, lambda state: state["spans"])


def base_spans(text: Column) -> Column:
    """The valid identifiers of a text, by kind and then by place."""
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string>>")

    def of(kind: str, pattern: str) -> Column:
        hits = F.filter(matches(text, F.lit(pattern), kind), lambda s: valid(kind, s["value"]))
        return F.when(F.coalesce(text.rlike(_HINTS[kind]), F.lit(False)), hits).otherwise(none)

    return F.concat(*[of(kind, pattern) for kind, pattern in PATTERNS.items()])


def _entity(span: Column) -> Column:
    """What two mentions of one identifier share."""
    plain = F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat(span["kind"], F.lit(":"), plain)


def _terms(line: Column) -> Column:
    """The distinct words of a line, lower-case, without those inside e-mail addresses."""
    bare = F.when(F.contains(line, F.lit("@")), F.regexp_replace(line, PATTERNS["email"], " ")).otherwise(line)
    return F.array_distinct(F.regexp_extract_all(F.lower(bare), F.lit(TERM), F.lit(0)))


def disclosures(docs: DataFrame, evidence: int = EVIDENCE, at_least: float = DISCLOSURE) -> DataFrame:
    """Pairs ``(entity, term, disclosure)`` of identifiers and the words that give them away.

    With counts n over the distinct lines of the corpus, N in all, a word t and
    an identifier c: disclosure = log(N n(c,t) / (n(c) n(t))) / log(N / n(c)),
    which is 1 if t only occurs with c. A pair needs ``evidence`` distinct lines.

    Identifiers on fewer lines cannot have that, so they go before their words
    are listed. Exact word counts are made for words of pairs alone, and only
    if they are rare enough for the disclosure asked for.
    """
    lines = docs.select(F.explode(F.split("text", "\n", -1)).alias("line")).where(F.length("line") > 0)
    hinted = lines.where(F.col("line").rlike("|".join(_HINTS.values()))).distinct()
    spotted = hinted.select("line", F.array_distinct(F.transform(base_spans(F.col("line")), _entity)).alias("e"))
    mentions = written(spotted.where(F.size("e") > 0), "mentions").select(
        F.xxhash64("line").alias("h"), "line", F.explode("e").alias("entity")
    )
    counted = mentions.groupBy("entity").agg(F.count_distinct("h").alias("n_c")).where(F.col("n_c") >= evidence)
    words = salted_join(mentions, counted, ["entity"], ["h"]).select(
        "entity", "n_c", F.explode(_terms(F.col("line"))).alias("term")
    )
    pairs = written(
        words.groupBy("entity", "n_c", "term").agg(F.count(F.lit(1)).alias("n_ct")).where(F.col("n_ct") >= evidence),
        "pairs",
    )
    hashed = lines.select(F.xxhash64("line").alias("h"), "line")
    total = hashed.select("h").distinct().count()
    # A word on more lines than this has no pair of enough disclosure.
    reach = F.max(F.col("n_ct") * F.pow(F.lit(float(max(total, 1))) / F.col("n_c"), F.lit(1 - at_least)))
    wanted = written(pairs.groupBy("term").agg(reach.alias("most")), "terms")
    words_of = hashed.select("h", F.explode(_terms(F.col("line"))).alias("term"))
    # Frequent words go by small sketches first; three times the limit is 15 standard errors above it.
    # Only the lines of the words that are left are shuffled and counted exactly.
    sketch = F.approx_count_distinct("h", 0.15)
    rough = words_of.join(wanted, "term").groupBy("term", "most").agg(sketch.alias("about"))
    rare = written(rough.where(F.col("about") <= 3 * F.col("most")).select("term"), "rare-terms")
    term_counts = words_of.join(rare, "term").groupBy("term").agg(F.count_distinct("h").alias("n_t"))
    share = F.log(F.lit(float(max(total, 1))) * F.col("n_ct") / (F.col("n_c") * F.col("n_t"))) / F.log(
        F.lit(float(max(total, 1))) / F.col("n_c")
    )
    rated = pairs.join(term_counts, "term").where(F.col("n_c") < total).withColumn("disclosure", share)
    return rated.where(F.col("disclosure") >= at_least).select("entity", "term", "disclosure")


def _pattern(terms: Column) -> Column:
    """A pattern for any of the words, whole and in any case; the longest first."""
    return F.concat(
        F.lit(rf"(?iu)(?<!{_AROUND})(?:"), F.array_join(F.reverse(F.array_sort(terms)), "|"), F.lit(rf")(?!{_AROUND})")
    )


def _replaced(text: Column, pattern: Column, put: str, kind: str | None = None) -> Column:
    """The text with valid matches replaced."""
    found, pieces = _cut(text, pattern)

    def one(piece: Column, value: Column) -> Column:
        new = F.when(valid(kind, value), F.lit(put)).otherwise(value) if kind else F.lit(put)
        return F.concat(piece, F.when(value.isNull(), F.lit("")).otherwise(new))

    return F.array_join(F.zip_with(pieces, found, one), "")


def sanitise(
    docs: DataFrame, evidence: int = EVIDENCE, at_least: float = DISCLOSURE, remove_from: float = REMOVAL
) -> DataFrame:
    """All rows and columns of ``docs`` with ``spans`` and ``sanitised`` (others of these names are replaced).

    ``spans`` has (kind, start, end, value): the valid identifiers, by kind and
    place, then the words (kind ``term``) that disclose an identifier of the
    same document, outside of identifiers. In ``sanitised`` identifiers give way
    to their kind, words of a disclosure of ``remove_from`` or more go, other
    ones are generalised to ``[word]``.

    A null text has no spans and stays null. Rows with the same doc_id share
    the words to look for; a row without doc_id has identifiers alone. An empty
    table gives an empty one.
    """
    names = [c for c in docs.columns if c.lower() not in ("spans", "sanitised")]
    text = F.col("text")
    looked = docs.select(*[F.col(f"`{c}`") for c in names], base_spans(text).alias("_base"))
    held = looked.where("doc_id is not null").select(
        F.col("doc_id").alias("_id"), F.explode(F.array_distinct(F.transform("_base", _entity))).alias("entity")
    )
    told = disclosures(docs, evidence, at_least)
    by_doc = (
        salted_join(held, told, ["entity"], ["_id"])
        .groupBy("_id", "term")
        .agg(F.max("disclosure").alias("d"))
        .groupBy("_id")
        .agg(
            F.collect_set("term").alias("_terms"),
            F.collect_set(F.when(F.col("d") >= remove_from, F.col("term"))).alias("_gone"),
        )
    )
    joined = looked.join(by_doc, looked["doc_id"] == by_doc["_id"], "left")
    free = F.filter(
        matches(text, _pattern(F.col("_terms")), "term"),
        lambda t: ~F.exists("_base", lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])),
    )
    has_terms = F.col("_terms").isNotNull() & text.isNotNull()
    spans = F.when(has_terms, F.concat("_base", free)).otherwise(F.col("_base"))
    clean = text
    for kind, pattern in PATTERNS.items():
        clean = F.when(text.rlike(_HINTS[kind]), _replaced(clean, F.lit(pattern), f"[{kind}]", kind)).otherwise(clean)
    some_gone = has_terms & (F.size("_gone") > 0)
    clean = F.when(some_gone, _replaced(clean, _pattern(F.col("_gone")), "")).otherwise(clean)
    clean = F.when(has_terms, _replaced(clean, _pattern(F.col("_terms")), "[word]")).otherwise(clean)
    return with_columns(joined, spans=spans, sanitised=clean).select(*[F.col(f"`{c}`") for c in names], "spans", "sanitised")


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")
