"""Information-theoretic sanitisation of personal data, in DataFrame operations only.

Base spans (email, ip, card, phone) are found by patterns.  Each found value is a protected entity.  All words
of a text outside base spans, short ones and numbers too, are terms; over the corpus, co-occurrence gives the pointwise mutual
information of term and entity, and its share of the entity's information content,

    disclosure(t, e) = ln(N * (n(t, e) - discount) / (n(t) * n(e))) / ln(N / n(e)),

says how strongly the term reveals the entity (1: fully).  Counts are of distinct texts, so copies are no
evidence; n(t) counts all texts of the corpus.  The absolute discount smooths small counts: a pair seen in
one text is judged like any other, but needs a rarer term.  Wherever a term that reveals any entity stands, in whichever text, it is generalised to the
class of its shape (name, number, code, word) from ``generalise_at`` on, and removed from ``remove_at`` on.

Terms and entities are keyed by 64-bit hashes.  Entities that stand in the same texts reveal alike and are
counted as one class.  Before words are joined with the revealing terms, a filter of fixed size (2 MB,
broadcast) drops most that can't be among them; the join then decides.

Cases: a null text is the empty text without spans; an entity in every document has no information to
disclose; overlapping spans of different kinds are all reported, and the sanitised text replaces them as one;
repeated rows give repeated results and count once; an empty table gives no rows; further
columns are ignored.  Texts may be of any length: places of matches are summed in chunks, in time that grows
little faster than the number of matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundsmith.llm.common import stored, text_or_empty

#: Kinds in their order, and their patterns. Possessive repeats and the look-behinds change no match: a
#: local part or number that fits from within a run also fits from where the run, or the last match, ended.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that must hold for any match of the kind.
NEEDS = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike("[0-9]"), "phone": lambda t: t.contains("+")}
TERM = r"[\p{L}\p{N}]++"
SPAN = "array<struct<start:int,end:int,value:string>>"


#: Matches are placed in chunks of so many, so that arrays grow by short steps.
CHUNK = 128


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def match_spans(text: Column, pattern: str, keep, fields: dict[str, str]) -> Column:
    """Spans (start, end, ...) in code points of the matches that ``keep``: the pieces between matches place them.

    ``keep`` maps a match to whether it stays, or gives a struct of further ``fields`` (name to type) and null for none.
    """
    kind = "array<struct<start:int,end:int" + "".join(f",{f}:{t}" for f, t in fields.items()) + ">>"
    none = F.array().cast(kind)

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["value"]), F.lit(0))
        one = lambda more: F.array(F.struct(start.alias("start"), end.alias("end"), *(more[f].alias(f) for f in fields)))
        grown = _let(F.when(x["value"].isNotNull(), keep(x["value"])), lambda more: F.when(more.isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], one(more))))
        return F.struct(end.alias("at"), grown.alias("spans"))

    def chunk(c: Column, at: Column) -> Column:
        return F.aggregate(c, F.struct(at.alias("at"), none.alias("spans")), add, lambda acc: acc["spans"])

    def starts(chunks: Column) -> Column:
        length = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + x["gap"] + F.coalesce(F.length(x["value"]), F.lit(0))))
        step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all"))
        return F.aggregate(length, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), step, lambda acc: acc["all"])

    def placed(steps: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int")), lambda k: F.slice(steps, k * CHUNK + 1, CHUNK))
        many = _let(cut, lambda chunks: F.flatten(F.zip_with(chunks, starts(chunks), chunk)))
        return F.when(F.size(steps) <= CHUNK, chunk(steps, F.lit(0))).otherwise(many)

    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    return _let(F.zip_with(gaps, values, lambda g, v: F.struct(g.alias("gap"), v.alias("value"))), placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The Luhn checksum of a digit string is a multiple of ten."""
    from_right = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int"))
    doubled = F.transform(from_right, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.cast("double") <= 255)
    n = F.length(_digits(value))
    if kind == "card":
        return n.between(16, 19) & F.when(n.between(16, 19), luhn(_digits(value)))
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    found = match_spans(text, PATTERNS[kind], lambda v: F.when(_valid(kind, v), F.struct(v.alias("value"))), {"value": "string"})
    return F.when(NEEDS[kind](text), found).otherwise(F.array().cast(SPAN))


def blanked(text: Column, kind: str) -> Column:
    """The text with spaces in place of its spans of one kind, so that places stay."""
    spans = F.col(kind)
    begins = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text)))
    # Where each code point is one byte, a piece of the bytes is found without counting from the text's begin.
    by_bytes = F.zip_with(begins, ends, lambda a, b: F.substring(text.cast("binary"), a + 1, b - a).cast("string"))
    between = F.when(F.octet_length(text) == F.length(text), by_bytes).otherwise(F.zip_with(begins, ends, lambda a, b: F.substring(text, a + 1, b - a)))
    blanks = F.transform(spans, lambda s: F.repeat(F.lit(" "), s["end"] - s["start"]))
    out = F.array_join(F.zip_with(between, blanks, lambda p, q: F.concat(p, F.coalesce(q, F.lit("")))), "")
    return F.when(F.size(spans) > 0, out).otherwise(text)


def _entities(kind: str) -> Column:
    return F.transform(kind, lambda s: F.xxhash64(F.lit(kind), F.lower(s["value"])))


def _term(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


FILTER_WORDS = 1 << 18


def term_filter(terms: DataFrame) -> DataFrame:
    """One row with 2**24 bits: the bit of each term's hash is set. Its size is the same for any number of terms."""
    at = F.pmod("term", F.lit(FILTER_WORDS * 64))
    bits = terms.groupBy(F.shiftright(at, 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(term, 64) as int))")).alias("bits"))
    words = terms.sparkSession.range(FILTER_WORDS).join(bits, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")).alias("w"))
    return words.agg(F.transform(F.sort_array(F.collect_list("w")), lambda w: w["bits"]).alias("filter"))


def find_personal_data(docs: DataFrame, discount: float = 0.5, generalise_at: float = 0.7, remove_at: float = 0.9) -> DataFrame:
    """Per row: doc_id, text_hash, one span array per kind, and terms (start, end, action, disclosure)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    found = source.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", *(base_spans(F.col("text"), k).alias(k) for k in KINDS))
    for kind in KINDS:
        found = found.withColumn("text", blanked(F.col("text"), kind))
    found = stored(found.withColumnRenamed("text", "rest").withColumn("row", F.monotonically_increasing_id()), "pii")

    # Copies count once: one row stands for each text.
    n_rows = found.count()
    one = stored(found.groupBy("text_hash").agg(F.min("row").alias("row")).select("row"), "pii-texts", n_rows, 1 << 16)
    n_docs = one.count()
    words = F.array_distinct(F.transform(F.regexp_extract_all("rest", F.lit(TERM), F.lit(0)), _term))
    entities = F.array_distinct(F.concat(*map(_entities, KINDS)))
    # The rows of texts grow with the corpus, so they are never broadcast.
    one = one.hint("merge")
    texts = found.select("row", "rest").join(one, "row", "left_semi")
    n_term = texts.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("of_term"))
    some = found.where(F.size(entities) > 0).join(one, "row", "left_semi")
    some = stored(some.select("row", entities.alias("entities"), words.alias("words")), "pii-some")

    # Entities that stand in the same texts are one class.
    entity_rows = some.select("row", F.explode("entities").alias("entity"))
    sign = lambda k: F.bit_xor(F.xxhash64("row", F.lit(k)))
    n_entity = entity_rows.groupBy("entity").agg(F.count("*").alias("of_entity"), sign(1).alias("s1"), sign(2).alias("s2"))
    n_entity = stored(n_entity.select("entity", "of_entity", F.xxhash64("of_entity", "s1", "s2").alias("class")), "pii-entities")
    classes = entity_rows.join(n_entity, "entity").select("row", "class", "of_entity").distinct()
    n = F.lit(float(max(n_docs, 1)))
    # n(t, e) is at most n(e), so a term of more than N ** (1 - g) * n(e) ** g texts can't reach the threshold g.
    most = lambda of: 1.000001 * n ** (1 - generalise_at) * of**generalise_at
    largest = n_entity.agg(F.coalesce(F.max("of_entity"), F.lit(0))).first()[0]
    rare = stored(n_term.where(F.col("of_term") <= most(F.lit(float(largest)))), "pii-terms")
    in_text = some.select("row", F.explode("words").alias("term")).join(rare, "term")
    pairs = in_text.join(classes, "row").where(F.col("of_term") <= most(F.col("of_entity")))
    judged = pairs.groupBy("class", "term").agg(F.count("*").alias("both"), F.first("of_term").alias("of_term"), F.first("of_entity").alias("of_entity"))
    content = F.log(n / F.col("of_entity"))
    share = F.when(content > 0, F.log(n * (F.col("both") - discount) / (F.col("of_entity") * F.col("of_term"))) / content).otherwise(F.lit(0.0))
    revealing = judged.select("term", share.alias("disclosure")).where(F.col("disclosure") >= generalise_at).groupBy("term").agg(F.max("disclosure").alias("disclosure"))
    revealing = stored(revealing, "pii-revealing")

    # A term that reveals an entity does so in any text, whether or not the entity is spelt out there.
    def may_reveal(word: Column) -> Column:
        bits = lambda t: F.element_at("filter", F.shiftright(F.pmod(t, F.lit(FILTER_WORDS * 64)), 6).cast("int") + 1)
        return _let(_term(word), lambda t: F.when(F.getbit(bits(t), F.pmod(t, F.lit(64)).cast("int")) == 1, F.struct(t.alias("term"))))

    likely = found.select("row", "rest", term_filter(revealing).scalar().alias("filter"))
    likely = likely.select("row", F.explode(match_spans(F.col("rest"), TERM, may_reveal, {"term": "long"})).alias("t")).select("row", "t.*")
    action = F.when(F.col("disclosure") >= remove_at, "remove").otherwise("generalise").alias("action")
    hits = likely.join(revealing, "term").select("row", F.struct("start", "end", action, "disclosure").alias("t"))
    by_row = hits.groupBy("row").agg(F.sort_array(F.collect_list("t")).alias("terms"))
    rows = found.select("row", "doc_id", "text_hash", *KINDS).join(by_row, "row", "left")
    return rows.select("doc_id", "text_hash", *KINDS, F.coalesce("terms", F.expr("array()")).alias("terms"))


def sanitised(text: Column) -> Column:
    """The text of a row of ``find_personal_data`` with its base spans masked by kind and its terms generalised or removed."""
    mark = lambda k: F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{k.upper()}]").alias("to")))
    marks = [mark(k) for k in KINDS]
    # Terms generalise to the class of words of like shape.
    word = lambda t: F.substring(text, t["start"] + 1, t["end"] - t["start"])
    shape = lambda w: F.when(w.rlike("^[0-9]+$"), "[NUMBER]").when(w.rlike("[0-9]"), "[CODE]").when(w.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
    marks.append(F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["action"] == "remove", "[REMOVED]").otherwise(shape(word(t))).alias("to"))))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def add(acc: Column, s: Column) -> Column:
        grown = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["to"])
        return F.when(s["start"] >= acc["at"], F.struct(grown.alias("out"), s["end"].alias("at"))).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at")))

    return F.aggregate(F.sort_array(F.concat(*marks)), begin, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` rows with a sanitised text: doc_id, text."""
    found = find_personal_data(docs, **parameters).dropDuplicates(["doc_id", "text_hash"])
    found = found.withColumnRenamed("doc_id", "id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("text_hash"))
    return texts.join(found, same).select("doc_id", sanitised(F.col("text")).alias("text"))
