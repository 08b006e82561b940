"""Benchmark decontamination by template windows, in DataFrame functions only.

Texts are canonicalised: numbers, names (capitalised words) and units after a
number become typed placeholders, other signs go.  Windows of eight canonical
words of documents and benchmark items are joined by hash.  Windows that line
up at one offset form an alignment, and the original words behind the
placeholders must map one to one between the two texts.  So verbatim passages
and questions with changed numbers or names are both found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import let, read, row_hash, text_of, write_and_read

WINDOW = 8
#: Words of a window that are no placeholder.
LITERALS = 4
#: Windows in one alignment: 13 words in a row, or the whole item if it is shorter.
RUN = 6
UNITS = ("km", "kg", "cm", "mm", "mg", "ml", "ms", "m", "g", "l", "s", "h", "min", "miles", "mile", "feet", "foot",
         "inches", "meters", "metres", "liters", "litres", "grams", "hours", "hour", "minutes", "minute", "seconds",
         "second", "days", "day", "weeks", "months", "years", "year", "dollars", "euros", "cents", "percent", "degrees")
#: Benchmark windows up to this number (8 bytes each) are sent to every executor; more are joined by a shuffle.
BROADCAST_WINDOWS = 2_000_000
#: Most 64-bit words of the bitmap that sorts out windows before the join.  A fuller bitmap sorts out fewer of them
#: and changes no result.
BITMAP_WORDS = 16_384

_MARK = ""  # private-use character before a name or number
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SLOT_RE = rf"(\p{{Lu}}\p{{L}}*)|([0-9]+(?:[.,:/][0-9]+)*)(?:[ ]?({'|'.join(UNITS)})([^\p{{L}}]|$))?"


def _words(text: Column) -> Column:
    """Words of a text; names and numbers carry a mark, and a unit is joined to its number."""
    return F.split(F.regexp_replace(text, _SLOT_RE, f"{_MARK}$1$2$3$4"), r"\s+")


def slot_value(word: Column) -> Column:
    """What stands behind a placeholder, without signs around it."""
    return F.btrim(F.substring_index(word, _MARK, -1), F.lit(_SIGNS))


def placeholder(word: Column) -> Column:
    """The typed placeholder of a marked word."""
    value = F.substring_index(word, _MARK, -1)
    number = F.substring(value, 1, 1).between("0", "9")
    return F.when(number & value.rlike("[a-z]"), "<number unit>").when(number, "<number>").otherwise("<name>")


def canonical(word: Column) -> Column:
    """A word of a template: a placeholder, or the word without signs around it."""
    return F.when(word.contains(_MARK), placeholder(word)).otherwise(F.btrim(word, F.lit(_SIGNS)))


def _windows(words: Column, form=canonical) -> Column:
    """Hashes of all windows of eight words in their form, in order; pairs, fours and eights are hashed from halves."""
    def joined(apart: int, then):
        return lambda h: let(F.zip_with(h, F.slice(h, apart + 1, F.size(h)), lambda a, b: F.xxhash64(a, b)), then)

    def first(h: Column) -> Column:
        return F.when(F.size(h) >= WINDOW, F.slice(h, 1, F.size(h) - (WINDOW - 1)))

    return let(F.transform(words, lambda t: F.xxhash64(form(t))), joined(1, joined(2, joined(4, first))))


def item_windows(items: DataFrame) -> DataFrame:
    """item_id, ipos, w (hash), words, slots (places of placeholders), windows (per item)."""
    base = items.select("item_id", _words(text_of()).alias("all"), _windows(_words(text_of())).alias("ws"))
    cut = base.select("item_id", "all", F.posexplode_outer("ws").alias("ipos", "w")).select(
        "item_id", "ipos", "w", F.slice("all", F.col("ipos") + 1, WINDOW).alias("words"))
    places = F.filter(F.sequence(F.lit(0), F.lit(WINDOW - 1)), lambda i: F.get(F.col("words"), i).contains(_MARK))
    literal = F.filter("words", lambda t: ~t.contains(_MARK) & (F.btrim(t, F.lit(_SIGNS)) != ""))
    out = cut.filter(F.col("w").isNotNull() & (F.size(literal) >= LITERALS)).withColumn("slots", places)
    return out.join(out.groupBy("item_id").agg(F.count(F.lit(1)).alias("windows")), "item_id")


def _bitmap(wanted: DataFrame, n: int):
    """A test that every hash of ``wanted`` passes and few others do."""
    size = 1 << max(6, min((n // 4).bit_length(), BITMAP_WORDS.bit_length() - 1))

    def word(w: Column) -> Column:
        return w.bitwiseAND(F.lit(size - 1)).cast("int")

    def bit(w: Column) -> Column:
        return F.shiftrightunsigned(w, 40).bitwiseAND(F.lit(63)).cast("int")

    rows = wanted.groupBy(word(F.col("w")).alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(F.col("w")))).alias("bits"))
    words = [0] * size
    for r in rows.collect():  # at most BITMAP_WORDS rows
        words[r["at"]] = r["bits"]
    table = F.expr("array(" + ",".join(f"bigint('{x}')" for x in words) + ")")
    return lambda w: F.getbit(F.get(table, word(w)), bit(w)) == 1


def _one_to_one(slots: Column) -> Column:
    """Whether distinct pairs (i, d) map one to one."""
    one = F.size(slots)
    return (one == F.size(F.array_distinct(slots["i"]))) & (one == F.size(F.array_distinct(slots["d"])))


def _some_run(windows: Column, need: Column) -> Column:
    """Whether, of windows (ipos, slots), so many have unchanged slots, or so many in a row have slots that map one to one."""
    plain = F.filter(windows, lambda w: F.forall(w["slots"], lambda s: s["i"] == s["d"]))
    starts = F.sequence(F.lit(1), F.greatest(F.size(windows) - need + 1, F.lit(1)))
    return (F.size(windows) >= need) & ((F.size(plain) >= need) | let(F.array_sort(windows), lambda row: F.exists(
        starts, lambda i: let(F.array_distinct(F.flatten(F.slice(row, i, need)["slots"])), _one_to_one))))


def alignments(docs: DataFrame, items: DataFrame, keys: list[str], whole: bool = True) -> DataFrame:
    """Per document key, item and offset: matched windows, the item's windows, changed slots.

    Only alignments long enough and with consistent slots remain.  All slots of
    an alignment have to be consistent, or without ``whole`` those of a part of
    it that is long enough on its own.
    """
    bench = write_and_read(item_windows(items))
    wanted = write_and_read(bench.select("w").distinct())
    n = wanted.count()
    maybe = _bitmap(wanted, n)
    words = docs.select(*keys, _words(text_of()).alias("raw"))
    places = let(_windows(F.col("raw")), lambda ws: F.transform(
        F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: maybe(F.get(ws, i))),
        lambda i: F.struct(i.alias("pos"), F.get(ws, i).alias("w"))))
    # the outer form keeps Spark from working the windows out once more in a filter of its own
    cut = words.select(*keys, "raw", F.explode_outer(places).alias("at")).select(
        *keys, "at.pos", "at.w", F.slice("raw", F.col("at.pos") + 1, WINDOW).alias("seen"))
    hits = cut.join(F.broadcast(wanted) if n <= BROADCAST_WINDOWS else wanted, "w", "left_semi")
    pairs = F.transform("slots", lambda i: F.struct(
        slot_value(F.get(F.col("words"), i)).alias("i"), slot_value(F.get(F.col("seen"), i)).alias("d")))
    met = write_and_read(hits).join(bench, "w").select(
        *keys, "item_id", (F.col("pos") - F.col("ipos")).alias("shift"), "ipos", "windows", pairs.alias("slots"))
    # one window of the item at most per place of the alignment: lists are as long as an item
    parts = [] if whole else [F.collect_set(F.struct("ipos", "slots")).alias("parts")]
    lined = met.groupBy(*keys, "item_id", "shift").agg(
        F.count_distinct("ipos").alias("matched"), F.max("windows").cast("int").alias("windows"),
        F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"), *parts)
    need = F.least(F.lit(RUN), "windows")
    right = _one_to_one(F.col("slots"))
    return (lined.filter(F.col("matched") >= need)
            .filter(right if whole else right | _some_run(F.col("parts"), need))
            .select(*keys, "item_id", "matched", "windows",
                    F.size(F.filter("slots", lambda s: s["i"] != s["d"])).alias("changed_slots")))


def folded_copies(docs: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of documents that hold a run of an item's plain words, whatever their case and the signs around them."""
    def cut(table: DataFrame, *names: str) -> DataFrame:
        words = F.filter(F.transform(F.split(F.lower(text_of()), r"\s+"), lambda t: F.btrim(t, F.lit(_SIGNS))), lambda t: t != "")
        return table.select(*names, _windows(words, lambda t: t).alias("ws"))

    bench = cut(items, "item_id").select("item_id", F.posexplode_outer("ws").alias("ipos", "w")).filter("w is not null")
    bench = write_and_read(bench.join(bench.groupBy("item_id").agg(F.count(F.lit(1)).alias("windows")), "item_id"))
    wanted = write_and_read(bench.select("w").distinct())
    n = wanted.count()
    maybe = _bitmap(wanted, n)
    places = let(F.col("ws"), lambda ws: F.transform(
        F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: maybe(F.get(ws, i))),
        lambda i: F.struct(i.alias("pos"), F.get(ws, i).alias("w"))))
    seen = cut(docs, *keys).select(*keys, F.explode_outer(places).alias("at")).select(*keys, "at.pos", "at.w")
    hits = write_and_read(seen.join(F.broadcast(wanted) if n <= BROADCAST_WINDOWS else wanted, "w", "left_semi"))
    return (hits.join(bench, "w").groupBy(*keys, "item_id", (F.col("pos") - F.col("ipos")).alias("shift"))
            .agg(F.count_distinct("ipos").alias("matched"), F.max("windows").alias("windows"))
            .filter(F.col("matched") >= F.least(F.lit(RUN), "windows")).select(*keys).distinct())


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document and benchmark item found in it.

    item_windows: windows of the item; matched_windows: most in one alignment;
    changed_slots: fewest placeholders that differ there.  Empty or missing
    texts, texts and items under eight words and items made of placeholders
    alone match nothing.  Rows with equal doc_id count as one document, those
    without doc_id as one more.  Repeated items are reported once an id.
    """
    found = alignments(docs.select("doc_id", "text"), items.select("item_id", "text"), ["doc_id"])
    return found.groupBy("doc_id", "item_id").agg(
        F.max("matched").cast("bigint").alias("matched_windows"), F.max("windows").cast("bigint").alias("item_windows"),
        F.min("changed_slots").cast("bigint").alias("changed_slots"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows in which an item is found; rows are told apart by their hash.

    Finds more than ``contaminated``: parts of an alignment that are long enough
    count on their own, whatever its other slots do, and so do verbatim copies in
    any case, of items with few plain words too.  Items under eight words match nothing.
    """
    columns = docs.columns
    keyed = docs.withColumn("_row", row_hash(docs))
    texts, bench = keyed.select("_row", "text"), items.select("item_id", "text")
    bad = alignments(texts, bench, ["_row"], whole=False).select("_row").unionByName(
        folded_copies(texts, bench, ["_row"])).distinct()
    return keyed.join(write_and_read(bad), "_row", "left_anti").select(*columns)


def op5_template_windows(spark, sf: str) -> DataFrame:
    return contaminated(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


def oracle() -> str:
    """The same rows in SQL, with windows as text in place of hashes."""

    signs = _SIGNS.replace("'", "''")

    def words(table: str, key: str) -> str:
        marked = f"regexp_replace(coalesce(text, ''), '{_SLOT_RE}', '{_MARK}\\1\\2\\3\\4', 'g')"
        return f"SELECT {key}, row_number() OVER () AS rid, string_split_regex({marked}, '\\s+') AS raw FROM {table}"

    value = f"split_part(t, '{_MARK}', -1)"
    template = (f"CASE WHEN contains(t, '{_MARK}') THEN CASE WHEN regexp_matches({value}, '^[0-9]') THEN CASE WHEN "
                f"regexp_matches({value}, '[a-z]') THEN '<number unit>' ELSE '<number>' END ELSE '<name>' END "
                f"ELSE trim(t, '{signs}') END")

    def windows(table: str, key: str, pos: str) -> str:
        def row(column: str) -> str:
            return ", ".join([column, *[f"lead({column}, {i}) OVER o" for i in range(1, WINDOW)]])

        return (f"SELECT {key}, {pos}, [{row('c')}] AS w, [{row('t')}] AS words FROM (SELECT *, {template} AS c FROM "
                f"(SELECT {key}, rid, generate_subscripts(raw, 1) AS {pos}, unnest(raw) AS t FROM {table})) "
                f"WINDOW o AS (PARTITION BY rid ORDER BY {pos}) QUALIFY lead(c, {WINDOW - 1}) OVER o IS NOT NULL")

    return f"""
WITH dt AS ({words("documents", "doc_id")}), it AS ({words("benchmark", "item_id")}),
iw AS ({windows("it", "item_id", "ipos")}),
ik AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS windows FROM iw
       WHERE len(list_filter(words, lambda t: NOT contains(t, '{_MARK}') AND trim(t, '{signs}') <> '')) >= {LITERALS}),
dw AS (SELECT doc_id, pos, w, words AS seen FROM ({windows("dt", "doc_id", "pos")})),
hit AS (SELECT doc_id, item_id, pos - ipos AS shift, ipos, windows, words, seen FROM dw JOIN ik USING (w)),
cnt AS (SELECT doc_id, item_id, shift, count(DISTINCT ipos) AS matched, max(windows) AS windows FROM hit GROUP BY ALL),
sl AS (SELECT doc_id, item_id, shift, trim(split_part(words[k], '{_MARK}', -1), '{signs}') AS i,
              trim(split_part(seen[k], '{_MARK}', -1), '{signs}') AS d FROM hit, range(1, {WINDOW + 1}) AS r(k)
       WHERE contains(words[k], '{_MARK}') GROUP BY ALL),
sc AS (SELECT doc_id, item_id, shift, count(*) AS n, count(DISTINCT i) AS ni, count(DISTINCT d) AS nd,
              count(*) FILTER (WHERE i <> d) AS changed FROM sl GROUP BY ALL)
SELECT doc_id, item_id, max(matched) AS matched_windows, max(windows) AS item_windows,
       min(coalesce(changed, 0)) AS changed_slots
FROM cnt LEFT JOIN sc USING (doc_id, item_id, shift)
WHERE matched >= least({RUN}, windows) AND coalesce(n = ni AND n = nd, true)
GROUP BY doc_id, item_id"""
