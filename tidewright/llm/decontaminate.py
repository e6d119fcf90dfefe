"""Benchmark decontamination by templates, in DataFrame operations only.

Numbers, names and units become typed placeholders, so that a question with other parameters keeps its template.  Items
whose templates and repetitions of values agree ("N1 km and N1 km" is not "N1 km and N2 km") form one class; the windows of
every class are hash-joined with the windows that the documents have at each token, in one pass for all widths.  Matches
of a text and a class on one alignment are one occurrence.  A slot of the class that takes two values in it is in
conflict: its windows are not consistent.  A window of placeholders alone carries no template and is looked up by its
values, so tables of numbers match only themselves.

Two kinds of pairs are returned.  A document and an item, if windows with the item's own values (and windows without
slots) cover ``coverage`` of the item's tokens; with ``count_verbatim`` these count also where their slot is in conflict.
And, if there is no such item of the class, a document and the item of smallest id of the class, if consistent windows
cover that much: the item with other parameters.  ``template_id`` is the smallest id of the class; ``templates`` tells
which items belong to it, so no link is lost where many items share a template and no row is made for each of them.

Defined results: null and empty texts have no tokens and match nothing; items with the same words count as the one of
smallest id; items shorter than ``window`` tokens are compared whole; a document with a null id is not reported; rows that
repeat an id and text give one result; texts that share an id are looked at apart and reported together; ties are broken
by the smaller item id; further columns, also of the same names, are ignored; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import checkpointed

NUMBER, NAME, UNIT, BEYOND = "\ue000", "\ue001", "\ue002", "\ue003"  # private-use code points
WINDOW, COVERAGE = 8, 0.5
# Units of measure and money that may follow a number.
UNITS = "km|kilometers|kilometres|m|meters|metres|cm|mm|mi|miles?|feet|foot|ft|inch(?:es)?|kg|kilograms?|g|grams?|mg|lbs?|pounds?|oz|ounces?|l|liters?|litres?|ml|gallons?|s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|percent|dollars?|euros?|cents?|usd|eur|degrees?|mph|kmh|watts?|volts?"
# A capitalised word after a lower-case word, a number or a comma: inside a sentence.
NAMES = r"\p{Lu}(?<=[\p{Ll}\p{Nd},;:] \p{Lu})\p{Ll}+"
PLACE = "array<struct<item_at:int,width:int>>"


def tokens(text: Column) -> Column:
    """Lower-case words; a number, name or unit begins with its placeholder and keeps its value."""
    t = F.translate(text, "_" + NUMBER + NAME + UNIT, " ")
    t = F.lower(F.regexp_replace(t, NAMES, NAME + "$0"))
    n = F.regexp_replace(F.regexp_replace(t, r"(?<=\p{Nd})[.,](?=\p{Nd})", "_"), r"\p{Nd}[\p{Nd}_]*", f" {NUMBER}$0 ")
    n = F.regexp_replace(n, rf"({NUMBER}[\p{{Nd}}_]+) +({UNITS})(?![\p{{L}}\p{{M}}])", f"$1 {UNIT}$2")
    t = F.when(t.rlike(r"\p{Nd}"), n).otherwise(t)
    return F.array_remove(F.split(t, rf"[^\p{{L}}\p{{M}}\p{{Nd}}_{NUMBER}-{UNIT}]+"), "")


def is_slot(x: Column) -> Column:
    return (x >= NUMBER) & (x < BEYOND)


def template(words: Column) -> Column:
    """The words with placeholders in place of values."""
    return F.transform(words, lambda x: F.when(is_slot(x), F.substring(x, 1, 1)).otherwise(x))


def form_hashes(words: Column) -> Column:
    """A hash of each word's form: what a window's template is hashed from."""
    return F.transform(words, lambda x: F.xxhash64(F.when(is_slot(x), F.substring(x, 1, 1)).otherwise(x)))


def key_and_values(words: Column, hashes: Column, at: Column, width: Column) -> tuple[Column, Column]:
    """The key of a window and the values in its slots; a window of slots alone is known by its values."""
    own = F.slice(words, at + 1, width)
    return F.when(F.forall(own, is_slot), F.xxhash64(own)).otherwise(F.xxhash64(F.slice(hashes, at + 1, width))), F.filter(own, is_slot)


def windows(words: Column, hashes: Column, slots: Column, width: int) -> Column:
    """Array of (at, width, hash, values): a window at each token, without values, and those that hold one of the ``slots``
    (places) once more, with the values in them.  So what slots cost is paid near slots only."""
    w = F.lit(width)
    last = F.size(hashes) - w
    row = lambda i, key, values: F.struct(i.alias("at"), w.alias("width"), key.alias("hash"), values.cast("array<string>").alias("values"))
    every = F.transform(F.sequence(F.lit(0), last), lambda i: row(i, F.xxhash64(F.slice(hashes, i + 1, w)), F.lit(None)))
    near = F.array_distinct(F.flatten(F.transform(slots, lambda p: F.sequence(F.greatest(F.lit(0), p - w + 1), F.least(p, last)))))
    slotted = F.transform(near, lambda i: row(i, *key_and_values(words, hashes, i, w)))
    return F.when(last >= 0, F.when(F.size(slots) > 0, F.concat(every, slotted)).otherwise(every))


def members(benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item_id, words, hashes, vars, key, n_tokens, width, slotted) of the distinct items; ``vars`` numbers the values by their first place."""
    items = benchmark.select(F.col(item_id).alias("item_id"), tokens(F.col(item_text)).alias("words")).where(F.col("item_id").isNotNull() & (F.size("words") > 0))
    items = items.groupBy("words").agg(F.min("item_id").alias("item_id"))
    items = items.withColumn("forms", template(F.col("words"))).withColumn("known", F.array_distinct(F.filter("words", is_slot)))
    items = items.withColumn("vars", F.transform("words", lambda x: F.when(is_slot(x), F.array_position("known", x).cast("int")).otherwise(F.lit(0))))
    n = F.size("forms")
    return items.select("item_id", "words", form_hashes(F.col("words")).alias("hashes"), "vars", F.xxhash64("forms", "vars").alias("key"), n.alias("n_tokens"), F.least(n, F.lit(window)).alias("width"), (F.size("known") > 0).alias("slotted"))


def templates(benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, template_id): the class of every item with words; copies of an item are in its class."""
    own = members(benchmark, item_id, item_text)
    first = own.groupBy("key").agg(F.min("item_id").alias("template_id"))
    every = benchmark.select(F.col(item_id).alias("copy_id"), tokens(F.col(item_text)).alias("words"))
    return every.join(own.select("words", "key"), "words").join(first, "key").select(F.col("copy_id").alias("item_id"), "template_id").dropna().distinct()


def bare(places: Column) -> Column:
    return F.transform(places, lambda w: F.struct(w["item_at"].alias("item_at"), w["width"].alias("width")))


def covered(places: Column) -> Column:
    """How many tokens the windows of an array of arrays of places cover."""
    return F.size(F.array_distinct(F.flatten(F.transform(F.array_distinct(F.flatten(places)), lambda w: F.sequence(w["item_at"], w["item_at"] + w["width"] - 1)))))


def occurrences(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text, key, alignment, places, slots, conflicts, ...): what a text and a class share on one alignment."""
    widths = [r.width for r in items.select("width").distinct().collect()]  # at most as many as the window has tokens
    none = F.array().cast("array<struct<at:int,width:int,hash:bigint,values:array<string>>>")
    found = [F.coalesce(windows(F.col("words"), F.col("hashes"), F.col("slots"), w), none) for w in sorted(widths)]
    doc = docs.select("doc_id", "text", F.inline(F.concat(*found) if found else none))
    item = items.select("key", "words", "hashes", "width", F.explode(F.sequence(F.lit(0), F.col("n_tokens") - F.col("width"))).alias("item_at"))
    hash_, values = key_and_values(F.col("words"), F.col("hashes"), F.col("item_at"), F.col("width"))
    item = item.select("key", "item_at", "width", hash_.alias("hash"), (F.size(values) > 0).alias("has_slots")).distinct()
    classes = items.groupBy("key").agg(F.min("item_id").alias("template_id"), F.first("vars").alias("vars"), F.first("n_tokens").alias("n_tokens"))
    place = F.struct("item_at", "width", F.coalesce("values", F.array().cast("array<string>")).alias("values"))
    met = doc.join(item, ["hash", "width"]).where(F.col("has_slots") == F.col("values").isNotNull())
    each = met.groupBy("doc_id", "text", "key", (F.col("at") - F.col("item_at")).alias("alignment")).agg(F.collect_set(place).alias("places"))
    each = each.join(classes, "key")

    def with_vars(w: Column) -> Column:
        of = F.filter(F.slice("vars", w["item_at"] + 1, w["width"]), lambda v: v > 0)
        slots = F.zip_with(of, w["values"], lambda v, x: F.struct(v.alias("var"), x.alias("value")))
        return F.struct(w["item_at"].alias("item_at"), w["width"].alias("width"), slots.alias("slots"))

    each = each.withColumn("places", F.transform("places", with_vars)).withColumn("slots", F.array_distinct(F.flatten(F.transform("places", lambda w: w["slots"]))))
    of = F.array_distinct(F.transform("slots", lambda s: s["var"]))
    twice = F.filter(of, lambda v: F.size(F.filter("slots", lambda s: s["var"] == v)) > 1)
    each = each.withColumn("conflicts", F.when(F.size(of) < F.size("slots"), twice).otherwise(F.array().cast("array<int>")))
    return each.withColumn("consistent", F.filter("places", lambda w: ~F.arrays_overlap(F.transform(w["slots"], lambda s: s["var"]), "conflicts"))).drop("vars")


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, coverage: float = COVERAGE, count_verbatim: bool = False) -> DataFrame:
    """(doc_id, item_id, template_id, n_windows, covered_tokens, coverage, n_slots, verbatim) of the contaminated pairs."""
    words = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_text).alias("text"), tokens(F.col(doc_text)).alias("words")).where(F.col("doc_id").isNotNull())
    places = F.filter(F.transform("words", lambda x, i: F.when(is_slot(x), i)), lambda i: i.isNotNull())
    words = words.withColumn("hashes", form_hashes(F.col("words"))).withColumn("slots", places)
    items = members(benchmark, item_id, item_text, window)
    each = checkpointed(occurrences(words, items))  # a row per text, class and alignment that share a window
    at, pair = ["doc_id", "text", "key", "alignment"], ["doc_id", "key", "template_id", "n_tokens"]
    sizes = [F.col("covered_tokens").cast("long").alias("covered_tokens"), (F.col("covered_tokens") / F.col("n_tokens")).alias("coverage")]

    # Windows with slots that hold an item's own values.
    own = items.where("slotted").select("item_id", "key", "words", F.col("width").alias("w"), F.explode(F.sequence(F.lit(0), F.col("n_tokens") - F.col("width"))).alias("item_at"))
    own = own.withColumn("values", F.filter(F.slice("words", F.col("item_at") + 1, F.col("w")), is_slot)).where(F.size("values") > 0)
    own = own.select("item_id", "key", "item_at", F.xxhash64("values").alias("same"))
    seen = each.select(*at, F.explode("places" if count_verbatim else "consistent").alias("w")).where(F.size("w.slots") > 0)
    seen = seen.select(*at, "w.item_at", "w.width", F.xxhash64(F.transform("w.slots", lambda s: s["value"])).alias("same"))
    equal = seen.join(own, ["key", "item_at", "same"]).groupBy(*at, "item_id").agg(F.collect_set(F.struct("item_at", "width")).alias("same"))
    plain = bare(F.filter("consistent", lambda w: F.size(w["slots"]) == 0))
    with_slots = F.size(F.filter("places", lambda w: F.size(w["slots"]) > 0))
    of_item = each.join(equal.select("doc_id", "key", "item_id").distinct(), ["doc_id", "key"]).join(equal, [*at, "item_id"], "left_outer")
    of_item = of_item.withColumn("same", F.coalesce("same", F.array().cast(PLACE)))
    of_item = of_item.select(*pair, "item_id", "slots", plain.alias("plain"), "same", F.array_union(bare(F.col("consistent")), F.col("same")).alias("all"), (F.size("same") == with_slots).alias("whole"))
    of_item = of_item.withColumn("whole", F.col("whole") & (covered(F.array("plain", "same")) / F.col("n_tokens") >= coverage))
    of_item = of_item.groupBy(*pair, "item_id").agg(
        F.sum(F.size("all")).alias("n_windows"), covered(F.collect_list("all")).alias("covered_tokens"), covered(F.collect_list(F.array_union("plain", "same"))).alias("own_tokens"),
        F.size(F.array_distinct(F.flatten(F.collect_list("slots")))).alias("n_slots"), F.max("whole").alias("verbatim"),
    )
    of_item = of_item.where(F.col("own_tokens") / F.col("n_tokens") >= coverage)
    columns = ["doc_id", "item_id", "template_id", "n_windows", *sizes, F.col("n_slots").cast("long").alias("n_slots"), "verbatim"]

    of_class = each.where(F.size("consistent") > 0).groupBy(*pair).agg(
        F.sum(F.size("consistent")).alias("n_windows"), covered(F.collect_list(bare(F.col("consistent")))).alias("covered_tokens"), F.size(F.array_distinct(F.flatten(F.collect_list("slots")))).alias("n_slots"),
    )
    of_class = of_class.where(F.col("covered_tokens") / F.col("n_tokens") >= coverage).join(of_item.select("doc_id", "key"), ["doc_id", "key"], "left_anti")
    of_class = of_class.withColumn("item_id", F.col("template_id")).withColumn("verbatim", F.col("n_slots") == 0)
    return of_item.select(*columns).unionByName(of_class.select(*columns))


def clean(docs: DataFrame, benchmark: DataFrame, count_verbatim: bool = True) -> DataFrame:
    """The documents, with all their columns, without those that contain a benchmark item."""
    found = matches(docs, benchmark, count_verbatim=count_verbatim).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
