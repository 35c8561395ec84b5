"""Personal data: pattern spans, and terms that disclose the entities found, in DataFrame functions only.

Patterns find e-mail addresses, IPv4 addresses, card numbers and telephone
numbers.  The protected entities are their values and what of them recurs: an
address's domain and the words of its name, a network, an issuer's prefix, a
telephone number's prefix.  Over all different texts, whole as they are, the
point-wise mutual information between a word and an entity says how much of the
entity's information the word gives away (1: all of it).  A word whose share of
it reaches DISCLOSURE, and half of whose texts or more hold the entity, is a
disclosing term, if the texts they share carry more of it together than chance
gives anywhere in so many texts: together x information >= log(number of texts).  Entities of one text can't be told from
that text itself, so only recurring ones take part, with any number of texts
from two on.  A disclosing term is marked wherever it stands, also in texts
without the entity.  In sanitised texts entities are generalised to their
kind, terms are removed.

Positions are in code points, ends exclusive.  Null texts count as empty and
have no span; repeated rows get the same result each, and copies of a text
count once in the statistics.  Pattern matching never backs up through a
repeated group, so very long texts need no deep stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offersieve.llm.common import fresh_names, stored

KINDS = ("email", "ip", "card", "phone")
TERM = len(KINDS)
NAMES = (*KINDS, "term")
#: Least share of an entity's information, and of a word's texts that hold the entity.
DISCLOSURE, LIKELY = 0.5, 0.5
#: Disclosing terms that are broadcast at most (about 20 MB); beyond, a shuffled join is used.
_BROADCAST_TERMS = 200_000

# A match can only begin where the run of its first class begins, or where the last match ended.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Signs without which a text holds no match.
_SIGNS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?+[0-9]){13}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_SPAN = "struct<kind:int,start:int,end:int,value:string>"


def matches(text: Column, pattern: str | Column, kind: int) -> Column:
    """Leftmost non-overlapping matches, in order, as (kind, start, end, value)."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(0)).alias("value"), F.transform(F.split(text, pattern, -1), F.length).alias("gap"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.when(x["value"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out")))

    return F.aggregate(found, zero, add, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits, from the right every second one doubled, sum to a multiple of ten."""
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * (2 - i % 2))
    return F.aggregate(each, F.lit(0), lambda acc, d: acc + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


_HOLDS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": lambda v: F.when(F.length(_digits(v)).between(14, 19), _luhn(_digits(v))).otherwise(False),
    "phone": lambda v: F.length(_digits(v)).between(10, 15),
}


def _holding(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: _HOLDS[kind](s["value"]))


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def base_spans(text: Column) -> Column:
    """All pattern spans that hold, by start, then kind."""
    none = F.array().cast(f"array<{_SPAN}>")
    each = [
        F.when(_SIGNS[k](text), _holding(matches(text, PATTERNS[k], i), k)).otherwise(none)
        for i, k in enumerate(KINDS)
    ]
    return by_start(F.flatten(F.array(*each)))


def by_start(spans: Column) -> Column:
    return F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def _words(text: Column) -> Column:
    """Different words of three letters or more, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{3,}"), F.lit(0)))


def _entities(s: Column) -> Column:
    """The names of a span's entities: its value, and the parts of it that other values can share."""
    value, digits = F.lower(s["value"]), _digits(s["value"])
    name = lambda level, x: F.concat(F.lit(f"{level}:"), x)
    email = F.concat(F.array(name("email", value), name("domain", F.substring_index(value, "@", -1))), F.transform(_words(F.substring_index(value, "@", 1)), lambda w: name("name", w)))
    ip = F.array(name("ip", value), name("net", F.substring_index(value, ".", 2)))
    card = F.array(name("card", digits), name("issuer", F.substring(digits, 1, 6)))
    phone = F.array(name("phone", digits), name("area", F.substring(digits, F.lit(1), F.length(digits) - 7)))
    return F.when(s["kind"] == 0, email).when(s["kind"] == 1, ip).when(s["kind"] == 2, card).otherwise(phone)


def _outside(text: Column, spans: Column) -> Column:
    """The text without the spans."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def add(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.concat(acc["out"], gap, F.lit(" ")).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    return F.aggregate(spans, zero, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def disclosing_terms(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(term, entity, share) from all different texts (text) and, of those with entities, found (text_key, entities, words)."""
    total = float(texts.count())  # one number
    named = found.select("text_key", F.explode("entities").alias("entity"))
    recurring = named.groupBy("entity").agg(F.count("*").alias("n_entity")).where((F.col("n_entity") > 1) & (F.col("n_entity") < total))
    named = stored(named.join(stored(recurring, "recurring"), "entity"), "named")
    pairs = named.join(found.select("text_key", F.explode("words").alias("term")), "text_key").groupBy("entity", "term").agg(F.count("*").alias("together"), F.first("n_entity").alias("n_entity"))
    # With one text in common a pair can't carry enough.
    pairs = stored(pairs.where("together > 1"), "pairs")
    n_terms = texts.select(F.explode(_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    given = F.log(F.lit(total) * F.col("together") / (F.col("n_entity") * F.col("n_term")))
    share = given / F.log(F.lit(total) / F.col("n_entity"))
    told = pairs.hint("merge").join(n_terms, "term").select("term", "entity", share.alias("share"), (F.col("together") * given).alias("evidence"), (F.col("together") / F.col("n_term")).alias("held"))
    return told.where((F.col("share") >= DISCLOSURE) & (F.col("held") >= LIKELY) & (F.col("evidence") >= F.log(F.lit(total)))).drop("evidence", "held")


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, base, terms): base spans and disclosing-term spans of every row, text_key being the text's hash."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.unhex(F.sha2("text", 256)))
    base = keyed.withColumn("base", base_spans(F.col("text")))
    some = F.size("base") > 0
    entities = F.array_distinct(F.flatten(F.transform("base", _entities)))
    base = stored(base.select("doc_id", "text_key", "base", F.when(some, entities).alias("entities"), F.when(some, _words(_outside(F.col("text"), F.col("base")))).alias("words")), "base")
    found = stored(base.where(some).select("text_key", "entities", "words").dropDuplicates(["text_key"]), "found")
    texts = keyed.select("text_key", "text").dropDuplicates(["text_key"])
    terms = stored(disclosing_terms(texts, found).select("term").distinct(), "terms")
    n = terms.count()
    none = F.array().cast(f"array<{_SPAN}>")
    if not n:
        return base.select("doc_id", "text_key", "base", none.alias("terms"))
    # Words that disclose, wherever they stand. Letters need no quoting in a pattern.
    words = keyed.select("text_key", F.explode(_words(F.col("text"))).alias("term")).join(F.broadcast(terms) if n <= _BROADCAST_TERMS else terms, "term")
    of_text = stored(words.groupBy("text_key").agg(F.collect_set("term").alias("words")), "of_text")
    pattern = F.concat(F.lit(r"(?<!\p{L})(?iu:"), F.array_join(F.array_sort("words"), "|"), F.lit(r")(?!\p{L})"))
    extra = texts.join(of_text.hint("merge"), "text_key").select("text_key", matches(F.col("text"), pattern, TERM).alias("terms"))
    both = base.drop("entities", "words").join(stored(extra, "extra").hint("merge"), "text_key", "left")
    apart = F.filter("terms", lambda t: ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    return both.select("doc_id", "text_key", "base", F.coalesce(apart, none).alias("terms"))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term) for every row."""
    found = spans(docs)
    counts = [_count(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    every = by_start(F.concat("base", "terms"))
    return found.select(
        "doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(every).alias("spans"), F.size("terms").cast("long").alias("n_term")
    )


def sanitized(docs: DataFrame) -> DataFrame:
    """docs with entities generalised to [KIND] and disclosing terms removed; overlapping spans count as the first of them."""
    id_, key, own, spans_ = fresh_names(docs, "id", "key", "own", "spans")
    found = spans(docs).select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), by_start(F.concat("base", "terms")).alias(spans_))
    keyed = docs.withColumn(own, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    both = keyed.join(found.dropDuplicates([id_, key]), F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(key)))
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS], F.lit(""))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def replace(acc: Column, s: Column) -> Column:
        out = F.concat(acc["out"], F.substring("text", acc["at"] + 1, s["start"] - acc["at"]), labels[s["kind"]])
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(out.alias("out"), s["end"].alias("at")))

    text = F.aggregate(spans_, zero, replace, lambda acc: F.concat(acc["out"], F.substring("text", acc["at"] + 1, F.length("text"))))
    return both.select(*[F.when(F.col("text").isNotNull(), text).alias(c) if c == "text" else F.col(c) for c in docs.columns])
