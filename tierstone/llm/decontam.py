"""Benchmark items inside documents, also with other numbers, names and units. DataFrame functions only.

Tokens are words, numbers and sentence marks. Numbers, capitalised words inside a sentence and units after a
number become typed placeholders; other words are taken in small letters. A capitalised word that begins a sentence and a word all in
capitals may be a name or not: windows with such words have a second template, in which they are names. Windows of both templates are
joined by hash. A window in common is a leak if its slots are consistent: along one alignment of item and document, equal values of the
item must stand opposite equal values of the document. Where they don't, the windows without a value in conflict still count, and so do those that
agree with the most frequent value of the document for each of the item; these alone make a leak if they are most of the alignment.

Texts are searched for two words of each window at their distance first; only where both stand are windows and templates made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierstone.session import settle

WINDOW = 8  # tokens of a template window; an item with fewer is one window
FIXED = 4  # tokens of a window that must be literal words
BROADCAST_ROWS = 500_000  # distinct benchmark windows (8 bytes each) that are sent to all tasks; more are joined by shuffle

FOUND = "doc_id long, text_key long, item_id long, windows long, item_share double, changed int"
RUN = 3  # tokens of an item that is found word for word inside a text; a shorter one must be the whole text
PAIRS = 20_000  # word pairs that every task compares texts with; a benchmark with more is joined by the hashes of all windows

WORD = r"\p{N}+(?:[.,]\p{N}+)*|\p{L}+"
MARKS = r"[.!?:;\n]"
#: Scripts without blanks: a letter is a word.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
UNSPACED_WORD = rf"\p{{N}}+(?:[.,]\p{{N}}+)*|[{UNSPACED}]|[\p{{L}}&&[^{UNSPACED}]]+"
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yards mile miles mg g kg t oz lb lbs pound pounds ton tons ml l liter liters litre litres gallon gallons "
    "ms s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "hz khz mhz ghz w kw mw j kj v a k c f percent usd eur gbp dollar dollars euro euros cent cents b kb mb gb tb mph kmh kph"
).split()


def _let(value: Column, use) -> Column:
    """use(value), with value computed once, also where `use` names it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _templates(raw: Column) -> Column:
    """array<struct<c: template token, r: raw token>>; marks are left out."""
    def one(word: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(raw, i - 1)).otherwise(F.lit("."))
        first, low = F.substring(word, 1, 1), F.lower(word)
        starts = F.substring(before, 1, 1).isin(".", "!", "?", ":", ";", "\n")
        template = (
            F.when(first.isin(".", "!", "?", ":", ";", "\n"), F.lit(None))
            .when(F.lower(first) == F.upper(first), F.when(first.between("0", "9"), F.lit("#number")).otherwise(low))
            .when(F.substring(before, 1, 1).between("0", "9") & low.isin(UNITS), F.lit("#unit"))
            .when((first != F.lower(first)) & ~starts & (word != F.upper(word)), F.lit("#name"))
            .otherwise(low)
        )
        return F.struct(template.alias("c"), word.alias("r"))

    return F.filter(F.transform(raw, one), lambda t: t["c"].isNotNull())


def _extracted(text: str, marks: str = "") -> Column:
    """Words and numbers of a text, and what `marks` adds to them."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    cut = lambda pattern: F.regexp_extract_all(whole, F.lit(pattern + marks), F.lit(0))
    return F.when(whole.rlike(f"[{UNSPACED}]"), cut(UNSPACED_WORD)).otherwise(cut(WORD))


def with_tokens(table: DataFrame, text: str = "text") -> DataFrame:
    return table.withColumn("tokens", _let(_extracted(text, f"|{MARKS}"), _templates)).drop(text)


def with_words(table: DataFrame, text: str = "text") -> DataFrame:
    """words: what the tokens of a text are, in small letters and without templates."""
    return table.withColumn("words", F.transform(_extracted(text), F.lower)).drop(text)


def _windows(tokens: Column, size: int) -> Column:
    """Every run of `size` neighbours."""
    places = F.when(F.size(tokens) >= size, F.sequence(F.lit(1), F.size(tokens) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.slice(tokens, i, F.lit(size)))


def _cut(tokens: Column, size: int) -> Column:
    return _let(tokens, lambda t: _windows(t, size))


def _open(token: Column) -> Column:
    """Whether a word in small letters may be a name: it begins a sentence or is all in capitals."""
    first = F.substring(token["r"], 1, 1)
    return (first != F.lower(first)) & ~token["c"].startswith("#")


def _as_names(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.struct(F.when(_open(t), F.lit("#name")).otherwise(t["c"]).alias("c"), t["r"].alias("r")))


def _named_places(tokens: Column, size: int) -> Column:
    """Where the windows begin whose second template is another."""
    def around(n: Column) -> Column:
        places = F.filter(F.transform(tokens, lambda t, i: F.when(_open(t), i + 1)), lambda i: i.isNotNull())
        starts = F.flatten(F.transform(places, lambda i: F.sequence(F.greatest(F.lit(1), i - (size - 1)), F.least(i, n - (size - 1)))))
        return F.when(n >= size, F.array_distinct(starts)).otherwise(F.array().cast("array<int>"))

    return _let(F.size(tokens), around)


def _named_hashes(tokens: Column, size: int) -> Column:
    """Hash of the second template of every window that has another one."""
    def of(names: Column) -> Column:
        words = F.transform(names, lambda t: t["c"])
        return _let(words, lambda w: F.transform(_named_places(tokens, size), lambda i: F.xxhash64(F.lit(size), F.slice(w, i, F.lit(size)))))

    return _let(_as_names(tokens), of)


def _hashes(tokens: Column, size: int) -> Column:
    """Hash of every window; the size is part of it."""
    return _let(F.transform(tokens, lambda t: t["c"]), lambda words: F.transform(_windows(words, size), lambda w: F.xxhash64(F.lit(size), w)))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, item, size, hash, at, tokens of the window, named) for every window and template with enough literal words.

    item: item_id and text hash; named: 1 for second templates.
    """
    named = benchmark.select("item_id", "text", F.xxhash64("item_id", "text").alias("item"))
    items = with_tokens(named).withColumn("size", F.least(F.lit(window), F.size("tokens"))).filter(F.col("size") >= FIXED)
    place = F.explode(F.sequence(F.lit(1), F.size("tokens") - F.col("size") + 1))
    first = items.distinct().select("*", place.alias("at")).withColumn("part", F.slice("tokens", F.col("at"), F.col("size"))).withColumn("named", F.lit(0))
    second = first.filter(F.exists("part", _open)).withColumn("part", _as_names(F.col("part"))).withColumn("named", F.lit(1))
    cut = first.union(second)
    literal = F.size(F.filter("part", lambda t: ~t["c"].startswith("#")))
    return cut.filter(literal >= FIXED).select(
        "item_id", "item", "size", F.xxhash64(F.col("size"), F.col("part.c")).alias("hash"), "at", F.col("part").alias("item_part"), "named"
    )


def _consistent(parts: Column) -> Column:
    """struct<kept: the windows (arrays of slots) of an alignment that count, free: the number of them without a value in conflict>."""
    rival = lambda s, o: (s["kind"] == o["kind"]) & (s["item"] == o["item"])
    same = lambda s: s["item"] == s["doc"]

    def voted(slots: Column) -> Column:
        return F.transform(slots, lambda s: F.struct(
            s.alias("slot"), F.struct(F.size(F.filter(parts, lambda p: F.array_contains(p, s))), same(s), s["doc"]).alias("rank"),
        ))

    def judged(votes: Column) -> Column:
        chosen = F.filter(votes, lambda v: ~F.exists(votes, lambda o: rival(v["slot"], o["slot"]) & (o["rank"] > v["rank"])))
        single = F.filter(votes, lambda v: ~F.exists(votes, lambda o: rival(v["slot"], o["slot"]) & (o["slot"]["doc"] != v["slot"]["doc"])))
        names = lambda found: F.transform(found, lambda v: v["slot"])
        return _let(F.struct(names(chosen).alias("chosen"), names(single).alias("single")), windows_of)

    def windows_of(by: Column) -> Column:
        free = lambda p: F.forall(p, lambda s: same(s) | F.array_contains(by["single"], s))
        kept = F.filter(parts, lambda p: free(p) | F.forall(p, lambda s: F.array_contains(by["chosen"], s)))
        return F.struct(kept.alias("kept"), F.size(F.filter(parts, free)).alias("free"))

    return _let(F.array_distinct(F.flatten(parts)), lambda slots: _let(voted(slots), judged))


def whole_items(benchmark: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, item, item_words, total) of the items without a window that could be told: they are compared as they stand."""
    named = benchmark.select("item_id", "text", F.xxhash64("item_id", "text").alias("item"))
    rest = named.join(items.select("item").distinct(), "item", "left_anti").distinct()
    words = with_words(rest).filter(F.size("words") > 0).withColumnRenamed("words", "item_words")
    return words.withColumn("total", F.greatest(F.lit(1), F.size("item_words") - (WINDOW - 1)).cast("long"))


def search_keys(items: DataFrame, whole: DataFrame, window: int = WINDOW) -> DataFrame:
    """(word, key, item, whole): for every window, the two words of it that fewest items hold and how far apart they stand.

    A text with the window holds both words so far apart, as placeholders stand for one word each. Which two words are taken
    decides how many texts are looked at again, and nothing else. An item below RUN words has one key, its own text.
    """
    literal = F.filter(F.transform("item_part", lambda w, i: F.struct(w["c"].alias("word"), i.alias("at"))), lambda w: ~w["word"].startswith("#"))
    parts = items.select("item", F.xxhash64("item", "at", "named").alias("part"), F.explode(literal).alias("w"), F.lit(False).alias("whole"))
    placed = F.transform("item_words", lambda w, i: F.struct(w.alias("word"), i.alias("at")))
    runs = whole.filter(F.size("item_words") >= RUN).select("item", F.col("item").alias("part"), F.explode(F.slice(placed, 1, window)).alias("w"), F.lit(True).alias("whole"))
    words = parts.union(runs)
    held = words.groupBy("w.word").agg(F.countDistinct("item").alias("n"))
    rare = F.struct("n", (-F.length("word")).alias("length"), "word", F.col("w.at").alias("at"))
    two = words.withColumn("word", F.col("w.word")).join(held, "word").groupBy("item", "part", "whole").agg(F.slice(F.array_sort(F.collect_list(rare)), 1, 2).alias("two"))
    first, second = F.col("two")[0], F.col("two")[1]
    pairs = two.select(first["word"].alias("word"), F.concat(first["word"], F.lit("|"), second["word"], F.lit("|"), second["at"] - first["at"]).alias("key"), "item", "whole")
    short = whole.filter(F.size("item_words") < RUN).select(F.lit(None).alias("word"), F.concat_ws(" ", "item_words").alias("key"), "item", F.lit(True).alias("whole"))
    return pairs.union(short).distinct()


def _texts(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values) or "NULL"  # words have neither quotes nor backslashes


def found_keys(docs: DataFrame, words: list[str], keys: list[str], window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, key) for the keys of search_keys that a text holds."""
    steps = ", ".join(str(d) for d in range(1 - window, window) if d)
    pairs = f"""flatten(transform(
        filter(transform(words, (w, i) -> if(w IN ({_texts(words)}), i, NULL)), i -> i IS NOT NULL),
        i -> filter(transform(array({steps}), d -> concat(get(words, i), '|', get(words, i + d), '|', d)), k -> k IN ({_texts(keys)}))))"""
    short = f"if(size(words) < {RUN} AND concat_ws(' ', words) IN ({_texts(keys)}), array(concat_ws(' ', words)), array())"
    return with_words(docs).select("doc_id", "text_key", F.explode(F.array_distinct(F.expr(f"concat({pairs}, {short})"))).alias("key"))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, item_id, windows, item_share, changed): one row per document and item it gives away.

    windows: windows in common along the best alignment; item_share: the part of the item's windows that is; changed:
    slots with another value than in the item. docs needs doc_id and text, benchmark item_id and text; other columns are not read. Null and
    empty texts never match. Items of fewer than FIXED words, or without a window of as many literal words, are found only word for
    word: from RUN words on as a run inside a text, below that as the whole text. Repeated rows count once: documents are told apart by doc_id and text_key, the text's hash.
    """
    items = settle(item_windows(benchmark, window), "item-windows")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most `window` values
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    whole = settle(whole_items(benchmark, items), "whole-items")
    asked = settle(search_keys(items, whole, window), "search-keys")
    few = asked.select("word", "key").distinct().limit(PAIRS + 1).collect()
    if not few:
        return docs.sparkSession.createDataFrame([], FOUND)
    if len(few) > PAIRS:
        some = _by_joins(named, items, asked, sizes)
    else:
        hits = found_keys(named, sorted({r["word"] for r in few if r["word"]}), sorted({r["key"] for r in few}), window)
        some = hits.join(F.broadcast(asked), "key").select("doc_id", "text_key", "item", "whole").distinct()
    # only the documents that may have a window in common are looked at again
    some = settle(some, "matched-documents")
    found = _by_windows(named, items, sizes, some.filter("NOT whole"), window)
    return found.unionByName(_word_for_word(named, whole, some.filter("whole")))


def _by_joins(named: DataFrame, items: DataFrame, asked: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc_id, text_key, item, whole) for a benchmark of any size: the hashes of all windows, and the words of all texts, go through a join."""
    hashes = _let(F.col("tokens"), lambda t: F.concat(F.array().cast("array<long>"), *(h(t, s) for s in sizes for h in (_hashes, _named_hashes))))
    seen = with_tokens(named).select("doc_id", "text_key", F.explode(hashes).alias("hash"))
    by_hash = seen.join(items.select("hash", "item").distinct(), "hash").select("doc_id", "text_key", "item", F.lit(False).alias("whole"))
    text = F.when(F.size("words") < RUN, F.array(F.concat_ws(" ", "words"))).otherwise(F.array().cast("array<string>"))
    words = with_words(named).select("doc_id", "text_key", F.explode(F.array_union(F.array_distinct("words"), text)).alias("held"))
    by_word = words.join(asked.filter("whole").withColumn("held", F.coalesce("word", "key")), "held").select("doc_id", "text_key", "item", "whole")
    return by_hash.union(by_word).distinct()


def _texts_of(named: DataFrame, some: DataFrame) -> DataFrame:
    """Each text of the keys in `some` once."""
    keys = some.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    return named.join(keys, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left_semi").dropDuplicates(["doc_id", "text_key"])


def _word_for_word(named: DataFrame, whole: DataFrame, some: DataFrame) -> DataFrame:
    """Leaks of the items that are compared as they stand: a run of words of the text, or all of them."""
    texts = with_words(_texts_of(named, some)).withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    pairs = some.join(whole, "item").join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    spaced = lambda words: F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    inside = F.when(F.size("item_words") < RUN, F.col("words") == F.col("item_words")).otherwise(F.contains(spaced("words"), spaced("item_words")))
    return pairs.filter(inside).select(
        "doc_id", "text_key", "item_id", F.col("total").alias("windows"), F.lit(1.0).alias("item_share"), F.lit(0).alias("changed")
    )


def _by_windows(named: DataFrame, items: DataFrame, sizes: list[int], some: DataFrame, window: int) -> DataFrame:
    """Leaks of the items with windows, in the texts of `some`."""
    if not sizes:
        return named.sparkSession.createDataFrame([], FOUND)
    found = with_tokens(_texts_of(named, some))
    windows = None
    for size in sizes:
        cut = F.posexplode(_cut(F.col("tokens"), size)).alias("pos", "doc_part")
        first = found.select("doc_id", "text_key", cut).withColumn("doc_named", F.lit(0))
        second = first.filter(F.exists("doc_part", _open)).withColumn("doc_part", _as_names(F.col("doc_part"))).withColumn("doc_named", F.lit(1))
        part = first.union(second).withColumn("hash", F.xxhash64(F.lit(size), F.col("doc_part.c")))
        windows = part if windows is None else windows.union(part)
    known_parts = items if items.count() > BROADCAST_ROWS // window else F.broadcast(items)
    joined = windows.join(known_parts, "hash").filter(F.col("doc_part.c") == F.col("item_part.c"))
    slots = F.filter(
        F.zip_with("item_part", "doc_part", lambda i, d: F.struct(i["c"].alias("kind"), F.lower(i["r"]).alias("item"), F.lower(d["r"]).alias("doc"))),
        lambda s: s["kind"].startswith("#"),
    )
    alignment = ("doc_id", "text_key", "item_id", "item", "shift")
    placed = joined.select(*alignment[:4], (F.col("pos") + 1 - F.col("at")).alias("shift"), "at", (F.col("named") + F.col("doc_named")).alias("named"), slots.alias("slots"))
    # a window in common by several templates counts once, with the fewest names
    once = placed.groupBy(*alignment, "at").agg(F.min(F.struct("named", "slots")).alias("least"))
    # few bytes, but much work for each: as many tasks as a shuffle has, which small partitions would otherwise be merged from
    parts = int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    aligned = once.repartition(parts, *alignment).groupBy(*alignment).agg(
        F.collect_list("least.slots").alias("all"), F.collect_list(F.when(F.col("least.named") == 0, F.col("least.slots"))).alias("plain")
    )  # no more than the item has windows
    # names of second templates may be none: where they bring a conflict, the windows of first templates are judged alone
    tries = F.explode(F.filter(F.array("all", "plain"), lambda p: F.size(p) > 0)).alias("parts")
    judged = aligned.select(*alignment, tries).withColumn("judged", _consistent(F.col("parts"))).filter(
        (F.col("judged.free") > 0) | (2 * F.size("judged.kept") > F.size("parts"))
    )
    changed = F.size(F.filter(F.array_distinct(F.flatten("judged.kept")), lambda s: s["item"] != s["doc"]))
    best = judged.withColumn("windows", F.size("judged.kept").cast("long")).withColumn("changed", changed).groupBy("doc_id", "text_key", "item_id", "item").agg(
        F.max(F.struct("windows", (-F.col("changed")).alias("same"))).alias("best")
    )
    totals = items.groupBy(F.col("item").alias("_item")).agg(F.countDistinct("at").alias("total"))
    return best.join(totals, F.col("item") == F.col("_item")).select(
        "doc_id", "text_key", "item_id", F.col("best.windows").alias("windows"), (F.col("best.windows") / F.col("total")).alias("item_share"),
        (-F.col("best.same")).cast("int").alias("changed"),
    )


def without_leaks(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that give no item away."""
    bad = found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"].cast("string")) == bad["_key"]), "left_anti")
