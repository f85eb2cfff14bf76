"""Personal data: pattern spans, and terms that give protected entities away.

All on DataFrame functions. Patterns give the base spans. A protected entity is a value however it is written (digits of numbers,
addresses in lower case), or the name part of addresses, at whatever host; one at more than ROLE_HOSTS hosts is a role (info, sales) and none. Terms (runs of four or
more letters) are counted with the entities of their whole documents, over all
documents; a term's disclosure is P(entity | term) = documents in which they stand together / documents with the
term. Words that hold digits or @ give no terms of their own. A pair is formed only where it can reach GENERALISE: the term is in at most 1 / GENERALISE times as
many documents as the entity, which loses none. A term that stands with one entity in at least two different texts, and whose
disclosure reaches GENERALISE, is a further span wherever it occurs: it is replaced by [term], and from REMOVE
on it is left out. What these texts tell, log2(P(entity | term) / P(entity)) bits each, must also reach log2 of the number of different
terms, or so many terms would show it by chance with an entity that many documents hold. Base spans are replaced by their kind.

Possessive patterns and maximal character runs keep matching linear on hostile texts; they match what the plain
patterns match. Positions are running sums by doubling, and texts are cut from blocks, so n matches take n log n steps. Null texts count as empty. Repeated rows count as documents each, as different texts once. Null doc_ids are rows
like others. Extra columns stay, but for those named as results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize, scope, small

GENERALISE, REMOVE, SUPPORT, ROLE_HOSTS = 0.5, 0.9, 2, 16
KINDS = ("email", "ip", "card", "phone")
#: One character each for a dot or separator inside a run; texts that hold them get another private character.
_DOT, _SPACE, _DASH, _OTHER = "\ue000", "\ue001", "\ue003", "\ue002"
_EMAIL = rf"(?:(?<![A-Za-z0-9._%+{_DOT}-])|\G)[A-Za-z0-9._%+{_DOT}-]++@[A-Za-z0-9-]++{_DOT}[A-Za-z0-9{_DOT}-]*+"
_IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = rf"(?<![0-9{_SPACE}{_DASH}])[0-9][0-9{_SPACE}{_DASH}]{{15,}}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


#: Code points a block, from which pieces of a text are cut.
_BLOCK_BITS = 10


def _let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def _running(rows: Column, combine) -> Column:
    """Running totals of an array under an associative combine(earlier, later), by doubling."""
    shifts = F.array(*(F.lit(1 << k) for k in range(31)))

    def over(own: Column) -> Column:
        def double(a: Column, shift: Column) -> Column:
            return F.transform(a, lambda x, i: F.when(i >= shift, combine(a[i - shift], x)).otherwise(x))

        return F.aggregate(F.filter(shifts, lambda s: s < F.size(own)), own, double)

    return _let(rows, over)


def _located(text: Column, pattern: str | Column, kind: str) -> Column:
    """Spans of all matches, by the lengths of the matches and of what lies between."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, p, F.lit(0))
    parts = F.zip_with(F.split(text, p, -1), found, lambda g, m: F.struct(m.alias("value"), F.coalesce(F.char_length(m), F.lit(0)).alias("n"), (F.char_length(g) + F.coalesce(F.char_length(m), F.lit(0))).alias("end")))
    ends = _running(parts, lambda x, y: F.struct(y["value"].alias("value"), y["n"].alias("n"), (x["end"] + y["end"]).alias("end")))
    return F.transform(F.filter(ends, lambda x: x["value"].isNotNull()), lambda x: F.struct(F.lit(kind).alias("kind"), (x["end"] - x["n"]).alias("start"), x["end"].alias("end"), x["value"].alias("value")))


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """Code points [start, end) of a text in blocks."""
    first = F.shiftright(start, _BLOCK_BITS)
    near = F.array_join(F.slice(blocks, first + 1, F.shiftright(end - 1, _BLOCK_BITS) - first + 1), "")
    return F.when(end > start, F.substring(near, start.bitwiseAND((1 << _BLOCK_BITS) - 1) + 1, end - start)).otherwise("")


def _clear(found: Column, base: Column) -> Column:
    """The spans of found that share no character with one of base, by start."""
    never = F.lit((1 << 31) - 1)

    def row(s: Column, own: bool) -> Column:
        left, right = (F.lit(0), never) if own else (s["end"], s["start"])
        return F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), s["value"].alias("value"), left.alias("left"), right.alias("right"))

    def reached(field: str, most):
        def combine(x: Column, y: Column) -> Column:
            return F.struct(*((most(x[c], y[c]) if c == field else y[c]).alias(c) for c in ("start", "own", "end", "value", "left", "right")))

        return combine

    both = F.array_sort(F.concat(F.transform(base, lambda s: row(s, False)), F.transform(found, lambda s: row(s, True))))
    back = _running(F.reverse(_running(both, reached("left", F.greatest))), reached("right", F.least))
    kept = F.filter(F.reverse(back), lambda s: s["own"] & (s["left"] <= s["start"]) & (s["right"] >= s["end"]))
    return F.transform(kept, lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def _luhn(digits: Column) -> Column:
    size = F.char_length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, size - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, value): by kind as listed, then start; code points, end exclusive."""
    none = F.array().cast(_SPAN)

    def as_written(spans: Column, marks: str, letters: str) -> Column:
        return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.translate(s["value"], marks, letters).alias("value")))

    plain = F.translate(text, _DOT + _SPACE + _DASH, _OTHER * 3)
    dotted = F.regexp_replace(plain, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _DOT)
    email = F.when(F.instr(text, "@") > 0, as_written(_located(dotted, _EMAIL, "email"), _DOT, ".")).otherwise(none)

    def small(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return (F.char_length(bare) < 3) | ((F.char_length(bare) == 3) & (bare <= "255"))

    ip = F.when(F.regexp_like(text, F.lit(r"[0-9]\.[0-9]++\.[0-9]")), F.filter(_located(plain, _IP, "ip"), lambda s: F.forall(F.split(s["value"], r"\."), small))).otherwise(none)
    joined = F.regexp_replace(F.regexp_replace(plain, r"(?<=[0-9])\x20(?=[0-9])", _SPACE), r"(?<=[0-9])-(?=[0-9])", _DASH)

    def card_like(s: Column) -> Column:
        digits = F.translate(s["value"], _SPACE + _DASH, "")
        return F.char_length(digits).between(16, 19) & _luhn(digits)

    card = F.when(F.regexp_like(text, F.lit(r"[0-9][0-9\x20-]{14}")), as_written(F.filter(_located(joined, _CARD, "card"), card_like), _SPACE + _DASH, " -")).otherwise(none)
    phone = F.when(F.instr(text, "+") > 0, F.filter(_located(plain, _PHONE, "phone"), lambda s: F.char_length(F.regexp_replace(s["value"], "[^0-9]", "")).between(8, 15))).otherwise(none)
    return F.concat(email, ip, card, phone)


def _entities(spans: Column) -> Column:
    """What is protected, as strings: kind:value however it is written, and name:address for an address's name part."""
    kind_is = lambda s, *kinds: s["kind"].isin(*kinds)

    def value(s: Column) -> Column:
        plain = F.when(kind_is(s, "card", "phone"), F.regexp_replace(s["value"], "[^0-9]", "")).when(kind_is(s, "ip"), F.regexp_replace(s["value"], "(?<![0-9])0+(?=[0-9])", ""))
        return F.concat(s["kind"], F.lit(":"), plain.otherwise(F.lower(s["value"])))

    names = F.transform(F.filter(spans, lambda s: kind_is(s, "email")), lambda s: F.concat(F.lit("name:"), F.lower(s["value"])))
    return F.array_distinct(F.concat(F.transform(spans, value), names))


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?<!\p{L})\p{L}{4,}+"), F.lit(0))


def _free_terms(text: Column) -> Column:
    """The terms without words that hold digits or @."""
    return F.array_distinct(_terms(F.regexp_replace(text, r"(?<!\S)[^\s@0-9]*+[@0-9]\S*+", " ")))


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, terms): the terms of a document that disclose an entity, as an array of (term, disclosure)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("text_hash", F.xxhash64("text"))
    held = _let(base_spans(F.col("text")), _entities)
    is_name, part = F.startswith("e", F.lit("name:")), lambda i: F.substring_index("e", "@", i)
    keys = (F.xxhash64(F.when(is_name, part(1)).otherwise(F.col("e"))).alias("entity"), F.when(is_name, F.xxhash64(part(-1))).alias("host"))
    at_hosts = rows.select("text_hash", F.explode(held).alias("e")).select("text_hash", *keys).groupBy("text_hash", "entity", "host").agg(F.count(F.lit(1)).alias("rows"))
    at_hosts = materialize(at_hosts, "entities")
    entities = at_hosts.groupBy("text_hash", "entity").agg(F.max("rows").alias("rows"))
    hosts = at_hosts.groupBy("entity").agg(F.countDistinct("host").alias("hosts"))
    spread = entities.groupBy("entity").agg(F.count(F.lit(1)).alias("texts"), F.sum("rows").alias("most")).where(F.col("texts") >= SUPPORT)
    spread = spread.join(hosts.where(F.col("hosts") <= ROLE_HOSTS), "entity")
    entities = materialize(entities.join(spread.select("entity", "most"), "entity"), "recurring-entities")
    limit = materialize(entities.groupBy("text_hash").agg(F.max("most").alias("most")), "entity-limits")
    often = materialize(rows.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("docs")), "term-docs")
    reachable = F.col("docs") * GENERALISE <= F.col("most")
    free = rows.join(small(limit), "text_hash").select("text_hash", "most", F.explode(_free_terms(F.col("text"))).alias("term")).join(often.where(F.col("docs") >= SUPPORT), "term").where(reachable)
    free = materialize(free.select("text_hash", "term", "docs").distinct(), "free-terms")
    pairs = free.join(entities, "text_hash").where(reachable).groupBy("entity", "term").agg(F.sum("rows").alias("together"), F.count(F.lit(1)).alias("texts"), F.first("docs").alias("docs"), F.first("most").alias("most"))
    pairs = pairs.where(F.col("texts") >= SUPPORT).withColumn("disclosure", F.col("together") / F.col("docs")).where(F.col("disclosure") >= GENERALISE)
    told_bits = F.col("texts") * F.log2(F.col("disclosure") * max(rows.count(), 1) / F.col("most"))
    pairs = pairs.where(told_bits >= F.log2(F.lit(max(often.count(), 1))))
    told = materialize(pairs.groupBy("term").agg(F.max("disclosure").alias("disclosure")), "told")
    words = rows.select("doc_id", "text_hash", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
    found = words.join(small(told), "term").distinct().groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("term", "disclosure"))).alias("terms"))
    return materialize(found, "doc-terms", keep=True)


def annotate(docs: DataFrame) -> DataFrame:
    """docs with spans (array of kind, start, end, value, by kind then start; kind term after the base kinds) and
    sanitized, the text with spans replaced."""
    with scope(docs.sparkSession):
        terms = small(disclosing_terms(docs)).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("terms").alias("__terms"))
    rows = docs.drop("spans", "sanitized").withColumn("__text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("__h", F.xxhash64("__text"))
    rows = rows.join(terms, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash")), "left")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.transform("__terms", lambda t: t["term"]), "|"), F.lit(r")(?!\p{L})"))
    rows = rows.withColumn("__base", base_spans(F.col("__text")))
    extra = F.when(F.col("__terms").isNotNull(), _clear(_located(F.col("__text"), pattern, "term"), F.col("__base"))).otherwise(F.array().cast(_SPAN))
    rows = rows.withColumn("spans", F.concat("__base", extra))
    strong = F.transform(F.filter(F.coalesce("__terms", F.array().cast("array<struct<term:string,disclosure:double>>")), lambda t: t["disclosure"] >= REMOVE), lambda t: t["term"])

    def label(s: Column) -> Column:
        gone = (s["kind"] == "term") & F.array_contains(strong, F.lower(s["value"]))
        return F.when(gone, F.lit("")).otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))

    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), label(s).alias("label"), s["end"].alias("reach"))))
    reach = _running(ordered, lambda x, y: F.struct(y["start"].alias("start"), y["end"].alias("end"), y["label"].alias("label"), F.greatest(x["reach"], y["reach"]).alias("reach")))
    blocks = F.regexp_extract_all("__text", F.lit(rf"(?s).{{1,{1 << _BLOCK_BITS}}}"), F.lit(0))

    def replaced(v: Column) -> Column:
        """A span that begins within what is already replaced gives nothing."""

        def piece(s: Column, i: Column) -> Column:
            past = F.when(i > 0, v["spans"][i - 1]["reach"]).otherwise(0)
            return F.when(s["start"] < past, "").otherwise(F.concat(_cut(v["blocks"], past, s["start"]), s["label"]))

        return F.concat(F.array_join(F.transform(v["spans"], piece), ""), _cut(v["blocks"], F.element_at(v["spans"], -1)["reach"], v["size"]))

    parts = F.struct(reach.alias("spans"), blocks.alias("blocks"), F.char_length("__text").alias("size"))
    rows = rows.withColumn("sanitized", F.when(F.size("spans") == 0, F.col("text")).otherwise(_let(parts, replaced)))
    return rows.select(*(c for c in docs.columns if c not in ("spans", "sanitized")), "spans", "sanitized")
