"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units of a text become typed placeholders; what is left is its template. Windows of
template words of the benchmark meet those of the documents in a hash join. Windows with names have a second key, in
small letters without name placeholders, so that copies in another case meet as well. Where windows of an item meet a
stretch of a document, they are one passage; it counts when it covers enough of the item's windows. A run of ``RUN``
windows one after the other (13 words) counts whatever share of the item it is. Then the slots are checked, between
aligned words only: each word of the item with the word of the document that the longest run puts there, equal words
first. One value of the item must stand for one value of the document, as it does in a question that was only given
new numbers and names. Inconsistent passages are kept apart and not reported; a run of ``RUN`` windows with the
item's own values always counts.

Words end at white space and at , ; : brackets and quotes (a comma before a digit stays); a sentence's last mark
is cut. A number starts with a digit, or with a currency or plus/minus sign and a digit. A unit is one of
``UNITS`` behind a number. A name is a capitalised word that neither starts the text nor follows a word that
ends a sentence. All else counts in small letters.

Rows: null texts have no windows, and a text of fewer words than a window is one window. A null id takes no
part. Repeated rows count once, as windows of one id are distinct by position. Extra columns are ignored; an
empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewatch.llm.shared import bounded, written

WINDOW = 5
COVERED = 0.5  # of an item's windows
RUN = 9  # windows: 13 words
GAP = 64  # words inside a passage, beside the length of the item
MAX_BROADCAST_WINDOWS = 2_000_000  # 16 bytes each and some overhead
MAX_BROADCAST_MATCHES = 150_000  # rows of ten longs, some 25 MB as a hashed relation
SPLIT = r'(?:[\s;:"()\[\]{}]|,(?![0-9]))+'
# Units: fixed words that follow a number.
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "feet", "foot", "ft", "yards", "mile", "miles", "meter", "meters", "kilometers",
    "mg", "g", "kg", "gram", "grams", "kilograms", "pound", "pounds", "lbs", "ounces", "ton", "tons", "ml", "l", "liter", "liters",
    "gallons", "s", "sec", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month",
    "months", "year", "years", "percent", "%", "dollar", "dollars", "cents", "euros", "degrees", "kmh", "mph", "watts", "volts",
)


def _is_number(t: Column) -> Column:
    behind = F.substring(t, 2, 1)
    # words of letters are told by the first two comparisons
    return ((t < ":") | (t > "~")) & (
        ((t >= "0") & (t < ":")) | (F.substring(t, 1, 1).isin("$", "€", "£", "+", "-", "#") & (behind >= "0") & (behind < ":"))
    )


def _marked(t: Column) -> Column:
    return t.endswith(".") | t.endswith("!") | t.endswith("?")


def _template_word(raw: Column, kind: Callable[[str], Column] = F.lit, plain_word: Callable[[Column, Column, Column], Column] | None = None) -> Callable:
    """The template word at each place: ``kind`` of a placeholder, or the word in small letters, of which ``plain_word`` may take another form."""

    def one(t: Column, i: Column) -> Column:
        before = F.get(raw, i - 1)
        plain = F.lower(F.when(_marked(t), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t))
        return (
            F.when(_is_number(t), kind("<num>"))
            .when((t >= "A") & (t < "[") & (i > 0) & ~_marked(before), kind("<name>"))
            .when(_is_number(before) & plain.isin(*UNITS), kind("<unit>"))
            .otherwise(plain_word(t, i, plain) if plain_word else plain)
        )

    return one


def _folded(t: Column) -> Column:
    return F.when(_marked(t), F.rtrim(F.lower(t), F.lit(".!?"))).otherwise(F.lower(t))


def _hashed(t: str | Column) -> Column:
    return F.xxhash64(F.lit(t) if isinstance(t, str) else t)


def _raw_words(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.where(F.col(id_col).isNotNull() & F.col("text").isNotNull()).select(
        F.col(id_col).cast("long").alias("id"),
        F.array_remove(F.split(F.col("text").cast("string"), SPLIT), "").alias("raw"),
    )


def _starts(size: int) -> tuple[Column, Column]:
    """The last place where a window of ``raw`` starts, and all such places."""
    last = F.greatest(F.size("raw") - size, F.lit(0))
    return last, F.when(F.size("raw") > 0, F.sequence(F.lit(0), last))


def windows(rows: DataFrame, id_col: str, size: int = WINDOW) -> DataFrame:
    """(id, n_windows, pos, window, folded, own, bare): every template window of every text.

    ``folded`` is the second key of a window with names, ``own`` the hash of its words, ``bare`` whether it is all
    placeholders. Each word is hashed once, in the lists; what is done for every window is done on these hashes, in
    code that Spark generates, as functions of lists are evaluated step by step.
    """
    low = _raw_words(rows, id_col).select("*", F.transform("raw", lambda t: _hashed(_folded(t))).alias("low"))
    # of a word without a mark at its end, both hashes are one
    plain_word = lambda t, i, plain: F.when(_marked(t), _hashed(plain)).otherwise(F.get("low", i))
    typed = low.select("*", F.transform("raw", _template_word(F.col("raw"), _hashed, plain_word)).alias("typed"))
    last, starts = _starts(size)
    # an outer explode: for the other kind, Spark asks for the list's size before the steps above, and works out every word anew
    placed = typed.select("id", "raw", "low", "typed", (last + 1).alias("n_windows"), F.explode_outer(starts).alias("pos")).where("pos is not null")
    at = [F.col("pos") + k for k in range(size)]
    plain = [F.when(F.get("typed", i) == _hashed("<name>"), F.get("low", i)).otherwise(F.get("typed", i)) for i in at]
    bare = F.lit(True)
    for i in at:
        holder = reduce(Column.__or__, (F.get("typed", i) == _hashed(k) for k in ("<num>", "<name>", "<unit>")))
        bare = bare & F.coalesce(holder | F.get("raw", i).startswith("<"), F.lit(True))
    keyed = placed.select(
        "id", "n_windows", "pos", F.xxhash64(*(F.get("typed", i) for i in at)).alias("window"), F.xxhash64(*plain).alias("folded"),
        F.xxhash64(*(F.get("low", i) for i in at)).alias("own"), bare.alias("bare"),
    )
    # a window without names has one key
    return keyed.withColumn("folded", F.nullif("folded", "window"))


def slots(rows: DataFrame, id_col: str, size: int = WINDOW) -> DataFrame:
    """(id, pos, slots): the words behind the placeholders of every window that has any."""
    words = _raw_words(rows, id_col)
    typed = words.select("id", "raw", F.transform("raw", _template_word(F.col("raw"))).alias("typed"), F.transform("raw", _folded).alias("low"))

    def one(i: Column) -> Column:
        own = [F.get("typed", i + k) for k in range(size)]
        holds = own[0].startswith("<")
        for t in own[1:]:
            holds = holds | F.coalesce(t.startswith("<"), F.lit(False))
        behind = F.array(*(F.when(t.startswith("<"), F.get("low", i + k)) for k, t in enumerate(own)))
        return F.struct(i.cast("int").alias("pos"), F.when(holds, behind).alias("slots"))

    # A step of its own: beside explode, every window would carry the whole text.
    listed = typed.select("id", F.transform(_starts(size)[1], one).alias("all"))
    return listed.select("id", F.explode_outer("all").alias("w")).select("id", "w.*").where("slots is not null")


def _keyed(rows: DataFrame) -> DataFrame:
    keys = F.when(F.col("folded").isNull(), F.array("window")).otherwise(F.array("window", "folded"))
    return rows.withColumn("key", F.explode_outer(keys)).drop("window", "folded")


def _runs(met: DataFrame, name: str) -> DataFrame:
    """``met`` with the start of each match's run along its diagonal."""
    along = Window.partitionBy("doc_id", "item_id", "diagonal").orderBy("pos")
    return met.withColumn(name, F.col("pos") - F.row_number().over(along))


def passages(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, covered: float = COVERED) -> DataFrame:
    """(doc_id, item_id, n_matched, n_windows, n_slots, consistent): the best passage of each item in each document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = written(_keyed(windows(benchmark, "item_id", size)))
    n_wanted = wanted.count()
    few = n_wanted <= MAX_BROADCAST_WINDOWS
    items = wanted.select(
        F.col("id").alias("item_id"), F.col("n_windows").alias("item_windows"), F.col("pos").alias("item_pos"), "key", F.col("own").alias("item_own"),
    )
    own = _keyed(windows(docs, "doc_id", size)).select(F.col("id").alias("doc_id"), "pos", "key", "own", "bare")
    met = own.join(F.broadcast(items) if few else items.hint("merge"), "key").select(
        "doc_id", "item_id", "item_windows", "pos", "item_pos", (F.col("own") == F.col("item_own")).alias("same"), "bare",
    )
    met = written(met.distinct()).withColumn("diagonal", F.col("pos") - F.col("item_pos"))
    # runs on a diagonal, the stretches of the document, and what each covers
    laid = _runs(met, "run")
    run = Window.partitionBy("doc_id", "item_id", "diagonal", "run")
    laid = laid.withColumn("long", F.count(F.lit(1)).over(run)).withColumn("told", F.sum((F.col("same") | ~F.col("bare")).cast("int")).over(run))
    by_pos = Window.partitionBy("doc_id", "item_id").orderBy("pos", "item_pos")
    far = F.col("pos") - F.lag("pos").over(by_pos) > F.col("item_windows") + GAP
    laid = laid.withColumn("far", F.coalesce(far, F.lit(False)).cast("int")).withColumn("stretch", F.sum("far").over(by_pos))
    laid = written(laid.drop("far"))
    key = ["doc_id", "item_id", "kind", "at", "diagonal"]
    whole = laid.withColumns({"kind": F.lit(0), "at": F.col("stretch").cast("long"), "own_diagonal": F.col("diagonal"), "diagonal": F.lit(0)})
    part = laid.where(F.col("told") >= RUN).withColumns({"kind": F.lit(1), "at": F.col("run").cast("long"), "own_diagonal": F.col("diagonal")})
    same = _runs(laid.where("same"), "run").withColumns({"kind": F.lit(2), "at": F.col("run").cast("long"), "own_diagonal": F.col("diagonal")})
    every = whole.unionByName(part).unionByName(same)
    counted = written(
        every.groupBy(*key, "item_windows").agg(F.count_distinct("item_pos").alias("n_matched")).where(
            F.when(F.col("kind") == 0, F.col("n_matched") >= covered * F.col("item_windows")).otherwise(F.col("n_matched") >= RUN)
        )
    )
    # only the documents with such a passage are read again, for what stands behind the placeholders
    # the files of these tables are tiny beside their rows, so how they are joined is told by their counts
    asked = written(every.where("kind < 2").join(bounded(counted.select(*key), MAX_BROADCAST_MATCHES), key, "left_semi"))
    again = written(asked.select("doc_id").distinct())
    mine = slots(docs.join(bounded(again), "doc_id", "left_semi"), "doc_id", size).select(
        F.col("id").alias("doc_id"), "pos", "slots"
    ).distinct()
    theirs = slots(benchmark, "item_id", size).select(
        F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots")
    ).distinct()
    theirs = theirs if n_wanted <= MAX_BROADCAST_MATCHES else theirs.hint("merge")
    asked = asked.select(*key, "pos", "item_pos", "same", "long", "own_diagonal")
    aligned = bounded(asked, MAX_BROADCAST_MATCHES).join(mine, ["doc_id", "pos"]).join(theirs, ["item_id", "item_pos"]).select(
        *key, "item_pos", "same", "long", "own_diagonal", F.posexplode(F.arrays_zip("slots", "item_slots")).alias("k", "s")
    ).where("s.slots is not null and s.item_slots is not null")
    words = aligned.groupBy(*key, (F.col("item_pos") + F.col("k")).alias("word")).agg(
        F.max_by(F.struct(F.col("s.slots").alias("mine"), F.col("s.item_slots").alias("theirs")), F.struct("same", "long", -F.col("own_diagonal"))).alias("pair")
    )
    pairs = words.select(*key, "pair.*").distinct().groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("theirs").alias("n_theirs")
    )
    judged = counted.join(pairs, key, "left").select(
        "doc_id", "item_id", "n_matched", F.col("item_windows").alias("n_windows"),
        F.coalesce("n_pairs", F.lit(0)).alias("n_slots"),
        F.coalesce(F.col("n_pairs") == F.col("n_theirs"), F.lit(True)).alias("consistent"),
    )
    best = F.max(F.struct("consistent", "n_matched", "n_slots", "n_windows")).alias("best")
    return judged.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "best.n_matched", "best.n_windows", "best.n_slots", "best.consistent"
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, covered: float = COVERED) -> DataFrame:
    """The passages whose slots are consistent."""
    return passages(docs, benchmark, size, covered).where("consistent").drop("consistent")
