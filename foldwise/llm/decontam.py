"""Benchmark decontamination by template canonicalisation (operator 8), DataFrame functions only.

Texts become templates: numbers, names (capitalised words inside a sentence) and units after
a number turn into typed placeholders, all else is lower-cased without punctuation. A second
template takes every capitalised word as a name, also at the start of a sentence; a third
form has the words themselves, numbers and signs included. Windows of all benchmark items in
these forms are hash-joined with the windows of all documents; joined windows are compared
word by word and agree if one form does. Windows of a document text and an item at one
distance form an alignment, whose names must be consistent: a benchmark name stands for one
document name. So a question with other numbers or names is found, and a chance agreement of
templates with contradicting names is not. Numbers and units may change one by one.

An alignment is a leak if at least `need` of its windows agree (all, if the item has fewer); contradicting names do not
matter if so many agree word for word.
Items shorter than the window are one window of their own length. Windows in which more than
half the words are placeholders prove nothing as templates and count only word by word.

The benchmark side is broadcast if its windows, which are counted, are at most
BROADCAST_WINDOWS; else both sides are shuffled by hash.

Defined results: null or empty texts and items without words match nothing; null ids match
like others; texts that share an id are judged one by one; repeated documents or items give
repeated pairs once per pair of ids; other
columns are not read; empty tables give an empty result; texts of any length count whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

WINDOW, NEED = 8, 6
#: Benchmark windows (about 200 bytes each) that may be broadcast.
BROADCAST_WINDOWS = 200_000
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"
SLOT = "<(number|name|unit)>"
# Units of measure that may follow a number.
UNITS = ["mm", "cm", "m", "km", "mg", "g", "kg", "ml", "l", "s", "min", "h", "ms", "mph", "kmh", "hz", "w", "kw", "v", "j", "%",
         "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "ounce", "ounces", "pound", "pounds", "gallon", "gallons",
         "meter", "meters", "metre", "metres", "liter", "liters", "litre", "litres", "gram", "grams", "second", "seconds", "minute",
         "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "degree", "degrees",
         "dollar", "dollars", "euro", "euros", "cent", "cents"]


def spaced(text: Column) -> Column:
    """The words of a text with single spaces between them."""
    return F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\s ]+", " "))


INSIDE = r"\p{Lu}(?<=[^.!?:\s] \p{Lu})[\p{L}'’-]*(?=[\s\p{P}]|$)"
ANYWHERE = r"\p{Lu}(?<=(?:^|[ \"“‘'(])\p{Lu})[\p{L}'’-]*(?=[\s\p{P}]|$)"


def template(flat: Column, capitals: str = INSIDE) -> Column:
    """Template of a text in the form of :func:`spaced`; word k stays word k."""
    # patterns begin with what is rare, and look back from there
    names = F.regexp_replace(flat, capitals, NAME)
    numbers = F.regexp_replace(names, r"[-+$€£]?\d+(?:[.,:/]\d+)*", NUMBER)
    units = F.regexp_replace(numbers, rf"(?i)({NUMBER} )(?:{'|'.join(UNITS)})(?=[\s\p{{P}}]|$)", f"$1{UNIT}")
    return F.lower(F.regexp_replace(units, r"[^\p{L}\p{M}<> ]+", ""))


def literal(flat: Column) -> Column:
    """A text with its numbers and signs, lower-cased, without the other punctuation."""
    # first, that a character is none of those that stay; signs are looked back from, not forward to
    signs = r"(?=[^ \p{L}\p{M}\p{N}\p{S}%*])(?:[^\p{L}\p{M}\p{N}\p{S}./,:%* -]+|[./,:-](?<![\p{Nd} ][./,:-])[./,:-]*|[./,:-]+(?![\p{Nd} ])|[.,:]+(?= |$))"
    bare_words = F.regexp_replace(flat, signs, "")
    return F.lower(bare_words)


#: The forms under which a window may agree: names inside sentences, names anywhere, and the words themselves.
FORMS = {"inside": template, "anywhere": lambda flat: template(flat, ANYWHERE), "literal": literal}


def _exploded(df: DataFrame, keys: list[str], sizes: list[int]) -> DataFrame:
    """(keys, flat, a word array of each form, size, pos, hashes) of every window of a table (keys, flat)."""
    rows = df.select(*keys, "flat", *[F.split(form(F.col("flat")), " ").alias(name) for name, form in FORMS.items()])
    rows = rows.select(*keys, "flat", *FORMS, F.posexplode("inside").alias("pos", "word"))

    def run(name, size):
        return F.xxhash64(*[F.get(name, F.col("pos") + k) for k in range(size)])

    def hashes(size):  # of words that lie in the text; others are null
        return F.when(F.col("pos") <= F.size("inside") - size, F.array(*[run(name, size) for name in FORMS]))
    if len(sizes) == 1:
        rows = rows.select(*keys, "flat", *FORMS, F.lit(sizes[0]).alias("size"), "pos", hashes(sizes[0]).alias("hashes"))
    else:
        runs = F.array(*[F.struct(F.lit(s).alias("size"), hashes(s).alias("hashes")) for s in sizes])
        rows = rows.select(*keys, "flat", *FORMS, "pos", F.inline(runs))
    return rows.where(F.col("hashes").isNotNull())


def bare(value: Column) -> Column:
    """A slot's value without the punctuation around it."""
    return F.lower(F.regexp_replace(value, r"^[^\p{L}\p{N}%]+|[^\p{L}\p{N}%]+$", ""))


def part_of(words: Column) -> Column:
    """The words of the window at pos."""
    return F.slice(words, F.col("pos") + 1, F.col("size"))


def _found(docs: DataFrame, benchmark: DataFrame, window: int, need: int) -> DataFrame:
    """(doc_id, tag, item_id, n_windows, item_windows, n_slots, reparameterised) of every leak; a tag is a hash of
    the text, so that rows of one id stay apart."""
    text = docs["text"].cast("string")
    flat = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), spaced(text).alias("flat")).where(text.rlike(r"[^\s ]"))  # flat <> '', told by the first such character
    items = (benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), spaced(benchmark["text"]).alias("flat"))
             .where("flat <> ''").distinct().withColumn("item_tag", F.xxhash64("flat")))
    words_of_item = F.size(F.split("flat", " "))
    items = items.withColumn("own", F.least(words_of_item, F.lit(window)))
    sizes = sorted(r["own"] for r in items.select("own").distinct().collect())  # at most `window` numbers
    if not sizes:
        sizes = [window]
    own = [_exploded(items.where(F.col("own") == size).select("item_id", "item_tag", "flat"), ["item_id", "item_tag"], [size])
           for size in sizes]
    item_windows = reduce(DataFrame.unionByName, own)

    def proves(name):  # the words themselves always do
        words = part_of(F.col(name))
        return F.lit(True) if name == "literal" else F.size(F.filter(words, lambda w: w.rlike(SLOT))) * 2 <= F.col("size")
    hashes = [F.when(proves(name), F.get("hashes", F.lit(k))) for k, name in enumerate(FORMS)]
    item_windows = item_windows.select("item_id", "item_tag", "size", F.col("pos").alias("item_pos"),
                                       F.array_distinct(F.array_compact(F.array(*hashes))).alias("hashes"),
                                       *[F.when(proves(name), part_of(F.col(name))).alias(f"item_{name}") for name in FORMS],
                                       part_of(F.split("flat", " ")).alias("item_values"))
    item_windows = written(item_windows, "item-windows")
    by_form = F.col("item_inside").isNotNull() | F.col("item_anywhere").isNotNull()
    per_item = item_windows.groupBy("item_id", "item_tag").agg(F.count("*").alias("item_windows"), F.count_if(by_form).alias("form_windows"))
    few = item_windows.count() <= BROADCAST_WINDOWS
    item_windows = item_windows.withColumn("hash", F.explode("hashes")).drop("hashes")
    if few:
        item_windows, per_item = F.broadcast(item_windows), F.broadcast(per_item)
    doc_windows = _exploded(flat, ["doc_id", "tag"], sizes)
    doc_windows = doc_windows.withColumn("hash", F.explode(F.array_distinct("hashes")))
    hits = doc_windows.join(item_windows, ["hash", "size"]).select(
        "doc_id", "tag", "item_id", "item_tag", "item_pos", (F.col("pos") - F.col("item_pos")).alias("shift"),
        *[f"item_{name}" for name in FORMS], "item_values",
        *[part_of(F.col(name)).alias(f"doc_{name}") for name in FORMS], part_of(F.split("flat", " ")).alias("doc_values"))
    same = {name: F.coalesce(F.col(f"doc_{name}") == F.col(f"item_{name}"), F.lit(False)) for name in FORMS}
    hits = hits.withColumns({"by_form": same["inside"] | same["anywhere"], "verbatim": same["literal"], "agrees": reduce(Column.__or__, same.values())}).where("agrees")
    # the slots of the form that agrees; words that agree themselves are slots with their own values
    kinds = F.when(same["inside"], F.col("item_inside")).when(same["anywhere"], F.col("item_anywhere")).otherwise(F.col("doc_inside"))
    hits = hits.withColumn("kinds", kinds)
    slot = F.filter(F.arrays_zip("kinds", "item_values", "doc_values"), lambda s: s["kinds"].rlike(SLOT))
    slots = F.transform(slot, lambda s: F.struct(s["kinds"].alias("kind"), bare(s["item_values"]).alias("a"),
                                                 bare(s["doc_values"]).alias("b")))
    found = (hits.select("doc_id", "tag", "item_id", "item_tag", "shift", "item_pos", "by_form", "verbatim", slots.alias("slots"))
             .groupBy("doc_id", "tag", "item_id", "item_tag", "shift")
             .agg(F.countDistinct("item_pos").alias("n_windows"),
                  F.countDistinct(F.when(F.col("by_form"), F.col("item_pos"))).alias("n_form"),
                  F.countDistinct(F.when(F.col("verbatim"), F.col("item_pos"))).alias("n_verbatim"),
                  F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots")))
    pairs = F.size("slots")
    names = F.filter("slots", lambda s: s["kind"].contains(NAME))
    one_name = F.size(names) == F.size(F.array_distinct(F.transform(names, lambda s: F.struct(s["kind"], s["a"]))))
    changed = F.exists("slots", lambda s: s["a"] != s["b"])
    enough = ((F.col("n_windows") >= F.least(F.lit(need), "item_windows"))
              | ((F.col("form_windows") > 0) & (F.col("n_form") >= F.least(F.lit(need), "form_windows"))))
    # enough windows word for word are a leak whatever the names in the others
    verbatim = F.col("n_verbatim") >= F.least(F.lit(need), "item_windows")
    return (found.withColumn("one_name", one_name).join(per_item, ["item_id", "item_tag"]).where(verbatim | (F.col("one_name") & enough))
            .select("doc_id", "tag", "item_id", "n_windows", "item_windows", pairs.alias("n_slots"), (~changed).alias("same")))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, need: int = NEED) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, n_slots, reparameterised) of every leaked pair."""
    best = F.max(F.struct("n_windows", "n_slots", "same", "item_windows"))
    return (_found(docs, benchmark, window, need).groupBy("doc_id", "item_id").agg(best.alias("best"))
            .select("doc_id", "item_id", F.col("best.n_windows").alias("n_windows"), F.col("best.item_windows").alias("item_windows"),
                    F.col("best.n_slots").cast("long").alias("n_slots"), (~F.col("best.same")).alias("reparameterised")))


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, need: int = NEED) -> DataFrame:
    """The rows of documents without a leak, with their own columns."""
    bad = _found(docs, benchmark, window, need).select(F.col("doc_id").alias("__leaked"), F.col("tag").alias("__tag")).distinct()
    own = docs["doc_id"].cast("long").eqNullSafe(bad["__leaked"]) & (F.xxhash64(docs["text"].cast("string")) == bad["__tag"])
    return docs.join(bad, own, "left_anti")
