"""PII: patterns find protected entities, and corpus co-occurrence finds the terms that give them away.

Native: DataFrame and SQL functions only. Entities are protected as they stand and as classes: the kind (any email, ip, card
or phone) and what an entity belongs to (mail domain, network, card issuer, country and area code). How strongly a term
reveals an entity is estimated from all documents: with `together` documents holding both, `n` the term and a share p
the entity, the chance of the entity given the term is q = (together + PRIOR_DOCS p) / (n + PRIOR_DOCS), shrunken towards
p, and the term gives away log2(q / p) bits. A term discloses an entity if the two meet in SUPPORT different texts, the
entity is likelier than not (LIKELY) and the term gives away BITS bits. It is generalised to its first letters; where those
disclose the entity too, it is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import table, written

#: Kinds in their order. The possessive forms and the look-behinds match what the plain patterns match, in linear time.
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A term is a run of letters and digits outside entities, of any length and script.
TERM = r"[\p{L}\p{N}]++"
#: Letters that a generalised term keeps, different texts in which term and entity must meet, pseudo-documents of the
#: prior, the least chance of the entity given the term, bits given away.
PREFIX, SUPPORT, PRIOR_DOCS, LIKELY, BITS = 3, 3, 2.0, 0.5, 3.0
#: Candidate terms (about 30 bytes each), and texts with their few naming terms, that may be broadcast; more are joined by a shuffle, with the same result.
BROADCAST_TERMS = 100_000
#: Levels of an entity: its kind, what it belongs to, itself.
KIND, GROUP, ITSELF = 0, 1, 2
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,match:string>>"
_BLOCK, _PIECE_BITS = 128, 10


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before_each(values: Column, op) -> Column:
    """What `op` makes of 0 and all values before each one, by blocks, so that work does not grow with the square of the array."""
    fold = lambda xs: F.aggregate(xs, F.lit(0), op)
    cut = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _BLOCK).cast("int")), lambda b: F.slice(xs, b * _BLOCK + 1, F.lit(_BLOCK)))
    before = lambda blocks: F.aggregate(F.transform(blocks, fold), F.array(F.lit(0)), lambda out, x: F.array_append(out, op(F.element_at(out, -1), x)))
    inside = lambda p: F.flatten(F.transform(p["blocks"], lambda xs, b: F.transform(xs, lambda _, i: op(F.get(p["before"], b), fold(F.slice(xs, F.lit(1), i))))))
    return let(values, lambda xs: let(cut(xs), lambda blocks: let(F.struct(blocks.alias("blocks"), before(blocks).alias("before")), inside)))


def located(text: Column, pattern: str | Column, kind: str, rank: int, valid) -> Column:
    """Spans of the pattern's matches that pass `valid`, in code points."""
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))

    def build(p: Column) -> Column:
        at = lambda i: F.get(p["s"], i) + F.length(F.get(p["g"], i))
        spans = F.transform(p["m"], lambda x, i: F.struct(at(i).alias("start"), F.lit(rank).alias("rank"), (at(i) + F.length(x)).alias("end"), F.lit(kind).alias("kind"), x.alias("match")))
        return F.filter(spans, lambda s: valid(s["match"]))

    def sized(p: Column) -> Column:
        sums = before_each(F.transform(p["m"], lambda x, i: F.length(x) + F.length(F.get(p["g"], i))), lambda a, x: a + x)
        return F.when(F.size(p["m"]) > 0, let(F.struct(p["m"].alias("m"), p["g"].alias("g"), sums.alias("s")), build))

    return F.coalesce(let(found, sized), F.array().cast(_SPAN))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


VALID = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: F.forall(F.split(x, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$")),
    "card": lambda x: F.length(digits(x)).between(14, 19) & F.call_function("luhn_check", digits(x)),
    "phone": lambda x: F.length(digits(x)).between(10, 15),
}
SIGN = {"email": lambda t: F.contains(t, F.lit("@")), "ip": lambda t: t.rlike("[0-9]"), "card": lambda t: t.rlike("[0-9]"), "phone": lambda t: F.contains(t, F.lit("+"))}


def base_spans(text: Column) -> Column:
    """All base spans, by start, then kind."""
    none = F.array().cast(_SPAN)
    return F.array_sort(F.concat(*(F.when(SIGN[k](text), located(text, PATTERNS[k], k, i, VALID[k])).otherwise(none) for i, k in enumerate(KINDS))))


def has_base(text: Column) -> Column:
    """Whether there is a base span."""
    out = F.lit(False)
    for k in KINDS:
        out = out | (SIGN[k](text) & F.exists(F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0)), VALID[k]))
    return out


def piece(parts: Column, lo: Column, hi: Column) -> Column:
    """Code points lo to hi of a text that is cut in parts of 1024, without counting from the start of the text."""
    first, stop = F.shiftright(lo, _PIECE_BITS), F.shiftright(F.greatest(hi, lo) + ((1 << _PIECE_BITS) - 1), _PIECE_BITS)
    return F.substring(F.array_join(F.slice(parts, first + 1, stop - first), ""), lo % (1 << _PIECE_BITS) + 1, F.greatest(hi - lo, F.lit(0)))


def rebuilt(text: Column, spans: Column, fill) -> Column:
    """text with spans, sorted by start, replaced by fill(span, how far the spans before it reach)."""
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << _PIECE_BITS}}}"), F.lit(0))
    reach = before_each(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x))

    def build(p: Column) -> Column:
        each = F.transform(p["spans"], lambda s, i: F.concat(piece(p["parts"], F.get(p["reach"], i), s["start"]), fill(s, F.get(p["reach"], i))))
        last = F.array_max(F.transform(p["spans"], lambda s: s["end"]))
        return F.concat(F.array_join(each, ""), piece(p["parts"], last, F.length(text)))

    return F.when(F.size(spans) > 0, let(F.struct(parts.alias("parts"), spans.alias("spans"), reach.alias("reach")), build)).otherwise(text)


def masked(text: Column, spans: Column) -> Column:
    """text with every character of the spans blanked, so that places stay."""
    return rebuilt(text, spans, lambda s, reach: F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], reach), F.lit(0))))


def sanitised(text: Column, spans: Column) -> Column:
    """text with base spans replaced by <KIND>, disclosing terms by their first letters and `*`, terms to remove by nothing; overlapping spans become the first one."""
    label = lambda s: F.when(s["kind"] == "removed", "").when(s["kind"] == "term", F.concat(F.substring(s["match"], 1, PREFIX), F.lit("*"))).otherwise(F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
    return rebuilt(text, spans, lambda s, reach: F.when(s["start"] >= reach, label(s)).otherwise(""))


def terms(text: Column) -> Column:
    """The different terms of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))


def features(text: Column) -> Column:
    """The different terms of a text and the generalised forms of them."""
    return let(terms(text), lambda xs: F.array_distinct(F.concat(xs, F.transform(xs, lambda x: F.concat(F.substring(x, 1, PREFIX), F.lit("*"))))))


def protected(spans: Column) -> Column:
    """The different (level, name) of the entities of a document."""

    def levels(s: Column) -> Column:
        own = F.when(s["kind"].isin("card", "phone"), digits(s["match"])).otherwise(F.lower(s["match"]))
        group = F.when(s["kind"] == "email", F.substring_index(own, "@", -1)).when(s["kind"] == "ip", F.substring_index(own, ".", 2)).when(s["kind"] == "card", F.substring(own, 1, 6)).otherwise(F.substring(own, 1, 4))
        named = {KIND: F.lit(""), GROUP: group, ITSELF: own}
        return F.array(*(F.struct(F.lit(level).alias("level"), F.concat(s["kind"], F.lit(":"), name).alias("name")) for level, name in named.items()))

    return F.array_distinct(F.flatten(F.transform(spans, levels)))


def entity_texts(plain: DataFrame) -> DataFrame:
    """(copy, rows, base, masked, entities, features) of each different text of `plain` (text) that has base spans; `copy` is its digest, rows are its documents."""
    found = plain.select(F.md5("text").alias("copy"), "text", base_spans(F.col("text")).alias("base")).where(F.size("base") > 0)
    each = found.groupBy("copy").agg(F.count("*").alias("rows"), F.first("text").alias("text"), F.first("base").alias("base"))
    each = each.select("copy", "rows", "base", masked(F.col("text"), F.col("base")).alias("masked"), protected(F.col("base")).alias("entities"))
    return written(each.withColumn("features", features(F.col("masked"))), "entity_texts")


def disclosing_terms(texts: DataFrame, held: DataFrame, plain: DataFrame) -> DataFrame:
    """(level, name, term, remove): which terms disclose which entities, by counts over all documents; support counts different texts, so that copies of one are no proof.

    `texts` are those with entities, `held` (copy, level, name, of_entity) what entities they hold. Terms are counted over all
    documents first, where these are, so that different terms and not their occurrences are sent; a term of which too few
    documents have any entity discloses none, and only the terms left, which are few, are paired with entities.
    """
    total = plain.count()
    prior = F.col("of_entity") / F.lit(total)
    chance = (F.col("together") + PRIOR_DOCS * prior) / (F.col("of_term") + PRIOR_DOCS)
    stands = texts.select("copy", "rows", F.explode("features").alias("term"))
    near = stands.groupBy("term").agg(F.sum("rows").alias("near"), F.count("*").alias("texts")).where(F.col("texts") >= SUPPORT)
    far = plain.where(~has_base(F.col("text"))).select(F.explode(features(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("far"))
    counted = near.join(far, "term", "left").withColumn("of_term", F.col("near") + F.coalesce("far", F.lit(0)))
    able = written(counted.where((F.col("near") + PRIOR_DOCS) / (F.col("of_term") + PRIOR_DOCS) >= LIKELY).select("term", "of_term"), "able")
    few = F.broadcast(able) if able.count() <= BROADCAST_TERMS else able
    met = stands.join(few, "term").join(held, "copy")
    pairs = met.groupBy("level", "name", "of_entity", "term", "of_term").agg(F.count("*").alias("texts"), F.sum("rows").alias("together")).where(F.col("texts") >= SUPPORT)
    sure = written(pairs.where((chance >= LIKELY) & (chance >= 2.0**BITS * prior)).select("level", "name", "term"), "disclosing")
    wide = sure.where(F.col("term").endswith("*")).select(F.col("level").alias("_l"), F.col("name").alias("_n"), F.col("term").alias("_t"))
    own = sure.where(~F.col("term").endswith("*"))
    same = (F.col("level") == F.col("_l")) & (F.col("name") == F.col("_n")) & (F.concat(F.substring("term", 1, PREFIX), F.lit("*")) == F.col("_t"))
    return written(own.join(wide, same, "left").select("level", "name", "term", F.col("_t").isNotNull().alias("remove")), "actions")


def marked_texts(plain: DataFrame) -> tuple[DataFrame, int]:
    """(copy, base, spans) of each different text of `plain` (text) with spans, and the number of those among them without base spans.

    Terms that disclose a kind or group are spans in the documents that hold such an entity, where they tell what was
    taken out; terms that disclose one entity are spans wherever they stand, since they name it. Documents without
    entities send their digest and the naming terms that they hold; their texts are not shuffled for it.
    """
    texts = entity_texts(plain)
    entities = texts.select("copy", "rows", F.explode("entities").alias("e")).select("copy", "rows", "e.level", "e.name")
    often = entities.groupBy("level", "name").agg(F.count("*").alias("texts"), F.sum("rows").alias("of_entity")).where(F.col("texts") >= SUPPORT).drop("texts")
    held = written(entities.join(often, ["level", "name"]).select("copy", "level", "name", "of_entity"), "held")
    actions = disclosing_terms(texts, held, plain)
    stands = texts.select("copy", F.explode("features").alias("term")).join(actions.select("term").distinct(), "term", "left_semi")
    hits = stands.join(held.select("copy", "level", "name"), "copy").join(actions, ["level", "name", "term"]).select("copy", "term", "remove")
    naming = actions.where(F.col("level") == ITSELF).groupBy("term").agg(F.max("remove").alias("remove"))
    count = naming.count()
    listed = lambda found: found.groupBy("copy", "term").agg(F.max("remove").alias("remove")).groupBy("copy").agg(F.sort_array(F.collect_list(F.struct("remove", "term"))).alias("terms"))
    if not count:
        return written(texts.join(listed(hits), "copy", "left").select("copy", "base", with_terms("masked", "base").alias("spans")), "marked"), 0
    few = F.broadcast(naming) if count <= BROADCAST_TERMS else naming
    hits = hits.unionByName(stands.join(few, "term").select("copy", "term", "remove"))
    other = plain.where(~has_base(F.col("text"))).select(F.md5("text").alias("copy"), "text")
    said = other.select("copy", F.explode(terms(F.col("text"))).alias("term")).join(few, "term")
    far = written(listed(said), "naming")
    copies = far.count()
    known = other.join(F.broadcast(far) if copies <= BROADCAST_TERMS else far, "copy").dropDuplicates(["copy"])
    known = known.select("copy", F.col("text").alias("masked"), "terms", F.array().cast(_SPAN).alias("base"))
    done = texts.join(listed(hits), "copy", "left").select("copy", "base", with_terms("masked", "base").alias("spans"))
    return written(done.unionByName(known.select("copy", "base", with_terms("masked", "base").alias("spans"))), "marked"), copies


def with_terms(text_col: str, base_col: str) -> Column:
    """base spans and the spans of `terms` (remove, term) in the masked text, by start."""

    def of(remove: bool, kind: str) -> Column:
        own = F.transform(F.filter("terms", lambda t: t["remove"] == F.lit(remove)), lambda t: t["term"])
        pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(own, "|"), F.lit(r")(?![\p{L}\p{N}])"))
        return F.when(F.size(own) > 0, located(F.col(text_col), pattern, kind, len(KINDS), lambda x: F.lit(True))).otherwise(F.array().cast(_SPAN))

    return F.when(F.col("terms").isNotNull(), F.array_sort(F.concat(base_col, of(False, "term"), of(True, "removed")))).otherwise(F.col(base_col))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms), a row for each document.

    Null texts are empty; texts without spans have an empty list and its checksum; ids may be null or repeated; an
    empty table gives no rows; columns of other names are not read.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    marked, _ = marked_texts(own.select("text"))
    keyed = own.select("doc_id", F.md5("text").alias("copy")).join(marked, "copy", "left")
    base, spans = (F.coalesce(c, F.array().cast(_SPAN)) for c in ("base", "spans"))
    n = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return keyed.select("doc_id", *map(n, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"), (F.size(spans) - F.size(base)).cast("long").alias("n_terms"))


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the text sanitised, and n_chars brought up to date where there is such a column; a null text stays null.

    Texts without spans stay as they are, where they are: those with entities are shuffled, and those without that hold a
    term which names a single entity find their spans by a broadcast of these, up to BROADCAST_TERMS texts. Texts of
    blanks and repeated rows are texts like any other, an empty table gives an empty table, and columns may have any names.
    """
    rows = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    marked, elsewhere = marked_texts(rows.select("text"))
    spans = marked.where(F.size("base") > 0).select("copy", "spans")
    bare = rows.where(~has_base(F.col("text")))
    if elsewhere:
        named = marked.where(F.size("base") == 0).select("copy", "spans")
        bare = bare.withColumn("copy", F.md5("text")).join(F.broadcast(named) if elsewhere <= BROADCAST_TERMS else named, "copy", "left")
    else:
        bare = bare.withColumn("spans", F.array().cast(_SPAN))
    found = rows.where(has_base(F.col("text"))).withColumn("copy", F.md5("text")).join(spans, "copy", "left")
    every = found.select("doc", "text", "spans").unionByName(bare.select("doc", "text", F.coalesce("spans", F.array().cast(_SPAN)).alias("spans")))
    done = every.withColumn("new", sanitised(F.col("text"), F.col("spans"))).withColumn("changed", F.size("spans") > 0)

    def column(c: str) -> Column:
        old = F.col("doc")[c]
        if c == text_col:
            return F.when(F.col("changed"), F.col("new")).otherwise(old.cast("string")).alias(c)
        return (F.when(F.col("changed"), F.length("new")).otherwise(old).cast("long") if c == "n_chars" else old).alias(c)

    return done.select(*map(column, docs.columns))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same in DuckDB: plain patterns, positions from the lengths of matches and of what stands between them."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    number = "regexp_replace(match, '[^0-9]', '', 'g')"
    doubled = f"list_transform(range(0, length({number})), lambda j: CAST({number}[length({number}) - j] AS INT) * (1 + j % 2) - CASE WHEN j % 2 = 1 AND CAST({number}[length({number}) - j] AS INT) > 4 THEN 9 ELSE 0 END)"
    valid = {
        "email": "true",
        "ip": "len(list_filter(string_split(match, '.'), lambda p: NOT regexp_matches(p, '^0*([0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$'))) = 0",
        "card": f"length({number}) BETWEEN 14 AND 19 AND list_sum({doubled}) % 10 = 0",
        "phone": f"length({number}) BETWEEN 10 AND 15",
    }
    sign = {"email": "'@'", "ip": "'.'", "card": "'0|1|2|3|4|5|6|7|8|9'", "phone": "'+'"}
    total = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda x: length(x))), 0)"
    place = f"{total('g[1:i]')} + {total('m[1:i-1]')}"
    runs = r"[\p{L}\p{N}]+"
    formed = f"unnest(list_distinct(list_concat(t, list_transform(t, lambda x: substr(x, 1, {PREFIX}) || '*')))) AS term"
    chance = f"(CAST(together AS DOUBLE) + {PRIOR_DOCS} * prior) / (of_term + {PRIOR_DOCS})"
    ctes = []
    for rank, k in enumerate(KINDS):
        where = "regexp_matches(text, '[0-9]')" if k == "card" else f"contains(text, {sign[k]})"
        ctes.append(f"{k}_m AS (SELECT doc_id, text, regexp_extract_all(text, '{plain[k]}') AS m, string_split_regex(text, '{plain[k]}') AS g FROM d WHERE {where})")
        ctes.append(f"{k}_s AS (SELECT doc_id, text, m, g, unnest(range(1, len(m) + 1)) AS i FROM {k}_m)")
        ctes.append(f"{k}_b AS (SELECT doc_id, text, CAST({place} AS BIGINT) AS start, {rank} AS rank, '{k}' AS kind, m[i] AS match FROM {k}_s)")
        ctes.append(f"{k}_v AS (SELECT *, start + length(match) AS stop FROM {k}_b WHERE {valid[k]})")
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {", ".join(ctes)},
  b AS ({" UNION ALL ".join(f"SELECT * FROM {k}_v" for k in KINDS)}),
  rep AS (SELECT text, count(*) AS rows, min(doc_id) AS copy FROM d WHERE doc_id IN (SELECT doc_id FROM b) GROUP BY text),
  r AS (SELECT copy, b.text, start, stop, rank, coalesce(max(stop) OVER (PARTITION BY copy ORDER BY start, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM b JOIN rep ON copy = doc_id),
  masked AS (SELECT copy, string_agg(substr(text, reach + 1, greatest(start - reach, 0)) || repeat(' ', greatest(stop - greatest(start, reach), 0)), '' ORDER BY start, rank) || substr(any_value(text), max(stop) + 1) AS text FROM r GROUP BY copy),
  e AS (SELECT copy, rows, kind, CASE WHEN kind IN ('card', 'phone') THEN {number} ELSE lower(match) END AS own FROM b JOIN rep ON copy = doc_id),
  c AS (SELECT DISTINCT copy, rows, {KIND} AS level, kind || ':' AS name FROM e
    UNION ALL SELECT DISTINCT copy, rows, {GROUP}, kind || ':' || CASE kind WHEN 'email' THEN regexp_replace(own, '^.*@', '') WHEN 'ip' THEN regexp_extract(own, '^[0-9]+\.[0-9]+') WHEN 'card' THEN substr(own, 1, 6) ELSE substr(own, 1, 4) END FROM e
    UNION ALL SELECT DISTINCT copy, rows, {ITSELF}, kind || ':' || own FROM e),
  often AS (SELECT level, name, CAST(sum(rows) AS DOUBLE) / (SELECT count(*) FROM d) AS prior FROM c GROUP BY 1, 2 HAVING count(*) >= {SUPPORT}),
  held AS (SELECT copy, rows, level, name, prior FROM c JOIN often USING (level, name)),
  own AS (SELECT copy, rows, {formed} FROM (SELECT copy, rows, regexp_extract_all(masked.text, '{runs}') AS t FROM masked JOIN rep USING (copy))),
  other AS (SELECT doc_id, {formed} FROM (SELECT doc_id, regexp_extract_all(text, '{runs}') AS t FROM d WHERE doc_id NOT IN (SELECT doc_id FROM b))),
  pairs AS (SELECT level, name, prior, term, sum(own.rows) AS together FROM own JOIN held USING (copy) GROUP BY 1, 2, 3, 4 HAVING count(*) >= {SUPPORT}),
  frequency AS (SELECT term, CAST(sum(n) AS DOUBLE) AS of_term FROM (SELECT term, sum(rows) AS n FROM own GROUP BY 1 UNION ALL SELECT term, count(*) FROM other GROUP BY 1) GROUP BY 1),
  sure AS (SELECT level, name, term FROM pairs JOIN frequency USING (term) WHERE {chance} >= {LIKELY} AND {chance} >= {2.0**BITS} * prior),
  action AS (SELECT s.level, s.name, s.term, w.term IS NOT NULL AS remove FROM sure s LEFT JOIN sure w ON s.level = w.level AND s.name = w.name AND w.term = substr(s.term, 1, {PREFIX}) || '*' WHERE NOT ends_with(s.term, '*')),
  hit AS (SELECT copy, term, bool_or(remove) AS remove FROM (
      SELECT copy, term, remove FROM own JOIN held USING (copy) JOIN action USING (level, name, term)
      UNION ALL SELECT copy, term, remove FROM own JOIN action USING (term) WHERE level = {ITSELF}
      UNION ALL SELECT doc_id, term, remove FROM other JOIN action USING (term) WHERE level = {ITSELF}) GROUP BY 1, 2),
  m AS (SELECT copy, text FROM masked UNION ALL SELECT doc_id, text FROM d WHERE doc_id NOT IN (SELECT doc_id FROM b)),
  t_m AS (SELECT copy, regexp_extract_all(text, '{runs}') AS m, string_split_regex(text, '{runs}') AS g FROM m WHERE copy IN (SELECT copy FROM hit)),
  t_s AS (SELECT copy, m, g, unnest(range(1, len(m) + 1)) AS i FROM t_m),
  t AS (SELECT t_s.copy, CAST({place} AS BIGINT) AS start, CASE WHEN remove THEN 'removed' ELSE 'term' END AS kind, m[i] AS match FROM t_s JOIN hit ON hit.copy = t_s.copy AND m[i] = term),
  same AS (SELECT doc_id, copy FROM d JOIN rep USING (text) UNION ALL SELECT doc_id, doc_id FROM d WHERE doc_id NOT IN (SELECT doc_id FROM b)),
  base AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS said FROM b GROUP BY 1),
  spans AS (SELECT doc_id, kind, start, stop, rank FROM b UNION ALL SELECT doc_id, kind, start, start + length(match), {len(KINDS)} FROM t JOIN same USING (copy)),
  every AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS said, count(*) FILTER (rank = {len(KINDS)}) AS n_terms FROM spans GROUP BY 1)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)}, sha256(coalesce(base.said, '')) AS base_sha256, coalesce(every.said, '') AS spans, coalesce(n_terms, 0) AS n_terms
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id)"""


OP9_SQL = _sql()
