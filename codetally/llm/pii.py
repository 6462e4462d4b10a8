"""Personal data: patterns first, then information-theoretic sanitisation of the words that give them away.

Addresses, numbers and the like are found by pattern (the base spans). The corpus then tells which words reveal them:
the words near an entity are its terms, and a term's disclosure is its pointwise mutual information with the entity,
relative to the entity's own information content,

    log(N * n(term, entity) / (n(term) * n(entity))) / log(N / n(entity))

with all four counted over different texts, so that copies of a document are evidence neither for a link nor against it.
A term seen in at least ``support`` different contexts of an entity is generalised from ``generalise`` on and removed from
``remove`` on, wherever it stands in a document that holds the entity.

Everything is DataFrame functions. Work per document is linear in its text; contexts are aggregated by entity and term,
words by word, both combined before they are moved.

Defined cases: a null text counts as empty. A document is known by its id and its text's hash; repeated rows get the
same spans. Positions are code points, ends exclusive. Where spans overlap, the sanitised text replaces them as one, by
the kind that starts first. An entity in every document has no information and no terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codetally.llm.shared import as_row, cut, documents

SUPPORT = 3
GENERALISE = 0.6
REMOVE = 0.9
CONTEXT_CHARS = 80
KINDS = ("email", "ip", "card", "phone", "general", "removed")
#: Tables of at most so many rows are sent to all tasks; larger ones are joined by shuffling.
MOST_BROADCAST = 100_000

# Possessive and anchored where a run of characters begins, which finds the same matches in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
# Whole chains of digits with single separators, of the only lengths that can pass.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Words of three letters or more between white space, with little punctuation around.
TERM_BEFORE, TERM_AFTER = r"(?<=\s[^\p{L}\s]{0,4})", r"(?=[^\p{L}\s]{0,4}\s)"
TERM = TERM_BEFORE + r"\p{L}{3,}" + TERM_AFTER

SPAN_TYPE = "array<struct<start:int, rank:int, kind:string, end:int, value:string>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _ip_fits(match: Column) -> Column:
    def fits(part: Column) -> Column:
        number = F.regexp_replace(part, "^0+", "")
        return (F.length(number) < 3) | ((F.length(number) == 3) & (number <= "255"))

    return F.forall(F.split(match, r"\."), fits)


def _luhn(match: Column) -> Column:
    """Whether the check digit is right: from the right, every other digit is doubled."""
    digits = F.filter(F.split(F.reverse(_digits(match)), ""), lambda d: d != "")

    def counted(digit: Column, i: Column) -> Column:
        number = digit.cast("int")
        doubled = 2 * number
        return F.when(i % 2 == 0, number).otherwise(doubled - F.when(doubled > 9, 9).otherwise(0))

    total = F.aggregate(F.transform(digits, counted), F.lit(0), lambda a, b: a + b)
    return (F.size(digits) >= 12) & (F.size(digits) <= 19) & (total % 10 == 0)


def _phone_fits(match: Column) -> Column:
    return F.length(_digits(match)).between(9, 15)


def _matches(text: Column, pattern: str | Column) -> Column:
    """Start, end and text of every match: the texts between the matches tell where they are."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda gap: F.length(gap))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int, end:int, value:string>>").alias("found"))

    def add(state: Column, pair: Column) -> Column:
        begin = state["at"] + pair["gap"]
        end = begin + F.length(pair["match"])
        one = F.array(F.struct(begin.alias("start"), end.alias("end"), pair["match"].alias("value")))
        return F.struct(end.alias("at"), F.concat(state["found"], one).alias("found"))

    pairs = F.filter(F.arrays_zip(between.alias("gap"), found.alias("match")), lambda p: p["match"].isNotNull())
    return F.aggregate(pairs, start, add, lambda state: state["found"])


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start and then kind."""
    empty = F.array().cast(SPAN_TYPE)

    def of(kind: str, pattern: str, hint: Column, fits=None) -> Column:
        found = F.transform(
            _matches(text, pattern),
            lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["value"].alias("value")),
        )
        found = F.filter(found, lambda m: fits(m["value"])) if fits else found
        # Most texts hold nothing of a kind, which one cheap look tells.
        return F.when(hint, found).otherwise(empty)

    parts = [
        of("email", EMAIL, F.contains(text, F.lit("@"))),
        of("ip", IP, text.rlike(IP), _ip_fits),
        of("card", CARD, text.rlike(CARD), _luhn),
        of("phone", PHONE, F.contains(text, F.lit("+")), _phone_fits),
    ]
    return F.array_sort(F.concat(*parts))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _entity(span: Column) -> Column:
    return F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"]))


def _blanked(text: Column, spans: Column) -> Column:
    """The text between two blanks, every span replaced by blanks: the words outside of spans."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(state: Column, span: Column) -> Column:
        begin, end = F.greatest(span["start"], state["at"]), F.greatest(span["end"], state["at"])
        part = F.concat(text.substr(state["at"] + 1, begin - state["at"]), F.repeat(F.lit(" "), end - begin))
        return F.struct(end.alias("at"), F.concat(state["parts"], F.array(part)).alias("parts"))

    blanked = F.aggregate(spans, start, add, lambda s: F.concat(F.array_join(s["parts"], ""), text.substr(s["at"] + 1, F.length(text))))
    return F.concat(F.lit(" "), F.when(F.size(spans) > 0, blanked).otherwise(text), F.lit(" "))


def _words(text: Column, spans: Column) -> Column:
    """The different terms of a text."""
    found = F.regexp_extract_all(_blanked(text, spans), F.lit(TERM), F.lit(0))
    return F.array_distinct(F.transform(found, F.lower))


def _marked(text: Column, spans: Column, telling: Column) -> Column:
    """The places of all telling terms in the whole text; a word that tells of two entities, by different degrees, is removed."""
    blanked = _blanked(text, spans)
    terms = F.transform(telling, lambda t: t["term"])
    forms = F.array_distinct(F.filter(F.regexp_extract_all(blanked, F.lit(TERM), F.lit(0)), lambda w: F.array_contains(terms, F.lower(w))))
    # Of letters only, so there is nothing to escape.
    pattern = F.concat(F.lit(TERM_BEFORE + "(?:"), F.array_join(forms, "|"), F.lit(")" + TERM_AFTER))
    removed = F.transform(F.filter(telling, lambda t: t["action"] == "removed"), lambda t: t["term"])

    def span(m: Column) -> Column:
        term = F.lower(m["value"])
        out = F.array_contains(removed, term)
        rank = F.when(out, KINDS.index("removed")).otherwise(KINDS.index("general"))
        kind = F.when(out, "removed").otherwise("general")
        return F.struct((m["start"] - 1).alias("start"), rank.alias("rank"), kind.alias("kind"), (m["end"] - 1).alias("end"), term.alias("value"))

    found = F.when(F.size(forms) > 0, F.transform(_matches(blanked, pattern), span).cast(SPAN_TYPE))
    return F.coalesce(found, F.array().cast(SPAN_TYPE))


def _terms_near(docs: DataFrame) -> DataFrame:
    """Every word near a base span: document, entity, term and a hash of the context; one row without term if there is none."""
    entity = docs.filter(F.size("base") > 0).select("id", "hash", "body", F.explode("base").alias("span"))
    start, end = F.col("span.start"), F.col("span.end")
    early, late = start <= CONTEXT_CHARS, F.length("body") - end <= CONTEXT_CHARS
    before = F.expr(f"substring(body, greatest(span.start - {CONTEXT_CHARS}, 0) + 1, least(span.start, {CONTEXT_CHARS}))")
    after = F.expr(f"substring(body, span.end + 1, {CONTEXT_CHARS})")
    # A word cut off by the context's edge has no white space beside it; the text's own edges count as such.
    sides = entity.select(
        "id", "hash",
        F.col("span.kind").alias("kind"),
        _entity(F.col("span")).alias("entity"),
        F.lower(F.concat(F.when(early, " ").otherwise(""), before, F.lit(" "))).alias("before"),
        F.lower(F.concat(F.lit(" "), after, F.when(late, " ").otherwise(""))).alias("after"),
    )

    terms = F.concat(*(F.regexp_extract_all(F.col(side), F.lit(TERM), F.lit(0)) for side in ("before", "after")))
    return sides.select("id", "hash", "kind", "entity", F.xxhash64("before", "after").alias("context"), F.explode_outer(F.array_distinct(terms)).alias("term"))


def _sent(table: DataFrame) -> DataFrame:
    """A written table, sent to all tasks if it is small."""
    return F.broadcast(table) if table.count() <= MOST_BROADCAST else table


def telling_terms(
    docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE
) -> DataFrame:
    """``id, hash, telling`` (terms and actions) of the documents with terms that disclose an entity of theirs.

    ``docs`` has ``id``, ``hash``, ``body`` (never null) and ``base`` (spans).
    """
    near = cut(_terms_near(docs))
    together = (
        near.filter("term is not null").groupBy("kind", "entity", "term")
        .agg(F.countDistinct("context").alias("contexts"), F.countDistinct("hash").alias("n_both")).filter(F.col("contexts") >= support)
    )
    entities = near.groupBy("kind", "entity").agg(F.countDistinct("hash").alias("n_entity"))
    different = cut(docs.groupBy("hash").agg(F.count(F.lit(1)).alias("copies")))
    total = float(different.count())
    repeated = _sent(cut(different.filter("copies > 1")))
    words = docs.select("hash", _words(F.col("body"), F.col("base")).alias("words")).join(repeated, "hash", "left")
    words = words.select(F.explode("words").alias("term"), F.coalesce("copies", F.lit(1).cast("bigint")).alias("copies"))
    # All copies of a text hold the same terms, so their rows divide evenly; no text is moved to tell copies apart.
    frequencies = words.groupBy("term", "copies").agg(F.count(F.lit(1)).alias("n")).groupBy("term").agg(F.sum((F.col("n") / F.col("copies")).cast("bigint")).alias("n_term"))

    counted = together.join(entities, ["kind", "entity"]).join(frequencies, "term")
    shared = F.log(total * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    disclosure = F.round(shared / F.log(total / F.col("n_entity")), 6)
    telling = _sent(cut(
        counted.filter(F.col("n_entity") < total).withColumn("disclosure", disclosure).filter(F.col("disclosure") >= generalise)
        .select("kind", "entity", "term", F.when(F.col("disclosure") >= remove, "removed").otherwise("general").alias("action"))
    ))
    # By entity and word of a document: an entity's whole list of terms would grow with the documents that hold it.
    known = F.array_distinct(F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), _entity(s).alias("entity"))))
    holding = docs.filter(F.size("base") > 0).select("id", "hash", _words(F.col("body"), F.col("base")).alias("words"), F.explode(known).alias("e"))
    holding = holding.select("id", "hash", "words", "e.kind", "e.entity").join(telling.select("kind", "entity"), ["kind", "entity"], "left_semi")
    found = holding.select("id", "hash", "kind", "entity", F.explode("words").alias("term")).join(telling, ["kind", "entity", "term"])
    return found.groupBy("id", "hash").agg(F.collect_set(F.struct("term", "action")).alias("telling"))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base_col: str = "base", spans_col: str = "spans", **thresholds) -> DataFrame:
    """Add ``base_col`` and ``spans_col``, arrays of ``struct(start, rank, kind, end, value)`` by start and kind.

    Columns that already have these names are replaced, all others are kept.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    known = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), body.alias("body"), base_spans(body).alias("base"))
    terms = _sent(cut(telling_terms(known, **thresholds).select(F.col("id").alias("of_id"), F.col("hash").alias("of_hash"), "telling")))
    rows = docs.select(as_row(docs.drop(base_col, spans_col)).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), base_spans(body).alias("base"))
    joined = rows.join(terms, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("hash") == F.col("of_hash")), "left")
    whole = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    marked = F.when(F.col("telling").isNotNull(), _marked(whole, F.col("base"), F.col("telling"))).otherwise(F.array().cast(SPAN_TYPE))
    found = joined.select("row", "base", F.array_sort(F.concat(F.col("base"), marked)))
    return found.toDF("row", base_col, spans_col).select("row.*", base_col, spans_col)


def sanitised(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets, removed terms by nothing."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(state: Column, span: Column) -> Column:
        marked = F.when(span["kind"] == "removed", "").otherwise(F.concat(F.lit("["), F.upper(F.when(span["kind"] == "general", "term").otherwise(span["kind"])), F.lit("]")))
        # A span that begins inside the one before only lengthens it.
        inside = span["start"] < state["at"]
        gap = F.when(inside, "").otherwise(F.concat(text.substr(state["at"] + 1, span["start"] - state["at"]), marked))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.concat(state["parts"], F.array(gap)).alias("parts"))

    rebuilt = F.aggregate(spans, start, add, lambda s: F.concat(F.array_join(s["parts"], ""), text.substr(s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, rebuilt).otherwise(text)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document."""
    found = find_personal_data(documents(spark, sf_dir).select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *(count(kind) for kind in KINDS[:4]),
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )
