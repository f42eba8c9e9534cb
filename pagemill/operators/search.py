"""Search: a table of queries against the postings of the document index.

Queries are rows ``(qid, q, domain, language)``; the last two are optional filters. All words of a query are
asked for first, exactly or within the typing errors that a word of that length may have; while fewer than
``TOP_K`` documents have them all, the last word is dropped. A document counts with the longest run of words from
the query's start that it holds. Ranking compares, in this order,

1. ``words``      length of that run, more first
2. ``typos``      summed errors of its words, a swap of neighbours counting as one, less first
3. ``proximity``  distance between neighbouring words of it, less first
4. ``attribute``  best field with a match, title first
5. ``exact``      words of it found whole and without an error, more first
6. ``rank_score`` of the document, larger first, then its url
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text
from pagemill.functions.binding import let
from pagemill.operators.indexing import FIELDS
from pagemill.operators.sizing import sized, small
from pagemill.session import cut_lineage

# Hits returned, words of a snippet, marks around a found word.
TOP_K = 20
CROP_WORDS = 150
PRE_TAG, POST_TAG = "<b>", "</b>"
CROP_MARK = "…"

# Shortest words that may have one and two typing errors.
ONE_TYPO_CHARS, TWO_TYPO_CHARS = 5, 9

# Words that find the documents of a query, and the most terms that are sent to the scan of the postings.
FIRST_WORDS, PUSHED_TERMS = 4, 2_000

# Hits of words that one task deals with, about: what a task holds does not grow with the index.
TASK_HITS = 250_000

# Words of a later block, and the most answers of words that are sent to all tasks.
LATER_WORDS, SENT_ANSWERS = 56, 500_000

# What a document has of a word: seven bits, three for its typos, three for its fields and one for the whole word; words in a long.
WORD_BITS, WORDS_IN_LONG = 7, 8

# A place in a document: the field above 32 bits of the position. The number of its word stands above.
PLACE_BITS = 34

# Fixed value: distance that counts for neighbouring words that are far apart or not both found.
MAX_GAP = 8


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct folded words of each query: ``(qid, slot, word)``, in order of appearance.

    Queries without a word are left out.
    """
    words = F.array_distinct(F.transform(text.words(F.col("q")), text.fold))
    return queries.filter(F.length("q") > 0).select("qid", F.posexplode(words).alias("slot", "word"))


def typo_budget(word: Column) -> Column:
    length = F.length(word)
    return F.when(length >= TWO_TYPO_CHARS, 2).when(length >= ONE_TYPO_CHARS, 1).otherwise(0)


def _piece_bounds(length: Column, pieces: int) -> Column:
    """Start and size of the even pieces of a word: array of ``(piece, start, size)``."""
    small_size = F.floor(length / pieces).cast("int")
    longer = (length % pieces).cast("int")
    return F.transform(
        F.sequence(F.lit(0), F.lit(pieces - 1)),
        lambda i: F.struct(
            i.alias("piece"),
            (i * small_size + F.greatest(i - (pieces - longer), F.lit(0)) + 1).alias("start"),
            (small_size + F.when(i >= pieces - longer, 1).otherwise(0)).alias("size"),
        ),
    )


def typo_distance(word: Column, term: Column, budget: int) -> Column:
    """Errors between a word and a term, if at most ``budget`` (1 or 2), else null.

    An error is a letter put in, left out, replaced, or swapped with its neighbour (Damerau 1964). Two errors with a
    swap among them are a swap on either side and one error between the results.
    """

    def swaps(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.concat(
            F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1, F.lit(1)), F.substr(w, i, F.lit(1)), F.substr(w, i + 2)
        ))

    def near(a: Column, b: Column) -> Column:
        return F.levenshtein(a, b, 1) >= 0

    def letters(w: Column) -> Column:
        return F.array_join(F.array_sort(F.split(w, "")), "")

    # A swap leaves the letters as they are and one more error changes two of them, one out and one in. What is four letters off is two
    # swaps or nothing.
    same_letters = F.levenshtein(letters(word), letters(term), 2)

    def decided(plain: Column) -> Column:
        # One swap is two replaced letters, so words that are farther apart are not put through their swaps for it.
        swapped = (plain == 2) & (F.length(word) == F.length(term)) & (F.length(word) > 1) & F.array_contains(swaps(word), term)
        out = F.when(plain.between(0, 1), plain).when(swapped, F.lit(1))
        if budget == 2:
            twice = (
                F.exists(swaps(word), lambda s: near(s, term)) | F.exists(swaps(term), lambda s: near(word, s))
                | F.arrays_overlap(swaps(word), swaps(term))
            )
            long_enough = (F.length(word) > 1) & (F.length(term) > 1)
            out = out.when(plain == 2, F.lit(2)).when((plain == 3) & (same_letters < 0), None).when((plain == 4) & (same_letters != 0), None)
            out = out.when((plain >= 3) & long_enough & twice, F.lit(2))
        return out

    # Two swaps are four replaced letters at most.
    return let(F.levenshtein(word, term, 2 * budget), decided)


def match_terms(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Index terms that answer each query word: ``(word, term, typos)``.

    ``words(word)`` and ``vocabulary(term)`` are distinct. A term within k errors of a word
    shares, unchanged and shifted by at most k, one of k + 1 even pieces (Li, Deng and Feng
    2011), unless an error is a swap across the cut of two pieces. With that swap undone there is one error less and the
    same rule holds, so the word is also asked for with the letter beyond the cut in the place of the last or first of a piece.
    Terms are joined to words on such a piece, so no two words are compared without
    one in common, and no true match is missed; the distance then decides.
    """
    exact = vocabulary.join(sized(words.select(F.col("word").alias("term"))), "term", "left_semi").select(
        F.col("term").alias("word"), "term", F.lit(0).alias("typos")
    )
    found = [exact]
    for budget in (1, 2):
        pieces = budget + 1
        asked = words.filter(typo_budget(F.col("word")) == budget)
        at, size, length = F.col("at"), F.col("size"), F.length("word")
        # Letters of the word that may be a piece of a term: as they are, and with a swap across the piece's end or start.
        parts = F.array(
            F.when((at >= 1) & (at + size - 1 <= length), F.substr("word", at, size)),
            F.when((F.col("piece") < pieces - 1) & (at >= 1) & (at + size <= length),
                   F.concat(F.substr("word", at, size - 1), F.substr("word", at + size, F.lit(1)))),
            F.when((F.col("piece") > 0) & (at >= 2) & (at + size - 1 <= length),
                   F.concat(F.substr("word", at - 1, F.lit(1)), F.substr("word", at + 1, size - 1))),
        )
        # Word side: every string that may equal a piece of a term of a length in reach.
        reach = F.sequence(F.length("word") - budget, F.length("word") + budget)
        keys = (
            asked.select("word", F.explode(reach).alias("size_of_term"))
            .select("word", "size_of_term", F.inline(_piece_bounds(F.col("size_of_term"), pieces)))
            .select("word", "size_of_term", "piece", "size",
                    F.explode(F.sequence(F.col("start") - budget, F.col("start") + budget)).alias("at"))
            .select("word", "size_of_term", "piece", F.explode(parts).alias("part")).filter("part is not null")
            .distinct()
        )
        # Term side: its k + 1 pieces, nothing more.
        terms = (
            vocabulary.filter(F.length("term") >= pieces)
            .select("term", F.length("term").alias("size_of_term"),
                    F.inline(_piece_bounds(F.length("term"), pieces)))
            .select("term", "size_of_term", "piece", F.substr("term", F.col("start"), F.col("size")).alias("part"))
        )
        close = (
            terms.join(sized(cut_lineage(keys)), ["size_of_term", "piece", "part"]).select("word", "term")
            .filter(F.levenshtein("word", "term", 2 * budget) >= 0).distinct()  # most pairs with a piece in common are far apart
            .withColumn("typos", typo_distance(F.col("word"), F.col("term"), budget))
            .filter(F.col("typos").between(1, budget))
        )
        found.append(close)
    return found[0].union(found[1]).union(found[2])


def match_prefixes(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Index terms that start with a query word and are longer: ``(word, term, typos)`` with no typos.

    ``words(word)`` and ``vocabulary(term)`` are distinct. A term is cut to each length that a word has and joined on equal
    starts: terms times lengths, of which there are few, and never terms times words.
    """
    lengths = words.select(F.length("word").alias("size")).filter("size > 0").distinct()
    starts = vocabulary.join(sized(cut_lineage(lengths)), F.length("term") > F.col("size")).select(
        F.substr("term", F.lit(1), F.col("size")).alias("word"), "term"
    )
    return starts.join(sized(words), "word").select("word", "term", F.lit(0).alias("typos"))


def last_words(queries: DataFrame) -> DataFrame:
    """``(qid, word)``: the last folded word of each query that ends with it, so that it may be the start of a longer one."""
    found = F.regexp_extract("q", rf"({text.WORD})$", 1)
    return queries.select("qid", text.fold(found).alias("word")).filter("word <> ''")


def of_terms(postings: DataFrame, terms: DataFrame, limit: int = PUSHED_TERMS) -> DataFrame:
    """Postings of the distinct ``terms``.

    A few terms go to the scan, which skips the files and row groups of a store in term order; more are joined.
    """
    few = terms.select("term").distinct().limit(limit + 1).collect()
    if len(few) <= limit:
        return postings.filter(F.col("term").isin([r["term"] for r in few]))
    return postings.join(sized(terms.select("term").distinct()), "term", "left_semi")


def _admitted(documents: DataFrame, queries: DataFrame, found: DataFrame) -> DataFrame:
    """Rows ``(qid, id)`` whose document passes the query's filters."""
    wanted = queries.select("qid", F.col("domain").alias("want_domain"), F.col("language").alias("want_language"))
    passes = lambda want, have: F.coalesce(F.col(want), F.lit("")).isin("") | (F.col(want) == F.col(have))
    return (
        found.join(documents.select("id", "domain", "language").hint("shuffle_hash"), "id").join(sized(wanted), "qid")
        .filter(passes("want_domain", "domain") & passes("want_language", "language"))
        .drop("want_domain", "want_language", "domain", "language")
    )


def _word_hits(postings: DataFrame, meant: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Postings with the ``word`` that their term answers, by ``meant(word, term, ...)``, of the documents ``ids`` if given.

    Both are stored tables. Words meet documents here and queries only afterwards, so a term that answers a word of many
    queries is one row.
    """
    few = meant.select("term").distinct().limit(PUSHED_TERMS + 1).collect()
    rows = postings.filter(F.col("term").isin([r["term"] for r in few])) if len(few) <= PUSHED_TERMS else postings
    if ids is not None:
        rows = rows.join(sized(ids), "id", "left_semi")
    return rows.join(sized(meant, SENT_ANSWERS), "term")


def _held(hits: DataFrame, slots: DataFrame, first: int, last: int, tasks: int, asked: DataFrame | None = None) -> DataFrame:
    """Per document and query, what the document has of the query's words from ``first`` to ``last``: seven bits each in longs ``m0`` ...

    ``hits`` are dealt by document, once, to as many ``tasks``; what follows stays in that place. ``slots(qid, slot, word)`` are distinct.
    With the stored pairs ``asked(qid, id)`` hits are dealt by document and word, and meet the words of these pairs alone.
    """
    bits = (
        F.when(F.col("typos") == 0, 1).when(F.col("typos") == 1, 2).otherwise(4)
        + F.when(F.col("field") == 0, 8).when(F.col("field") == 1, 16).otherwise(32) + F.when(F.col("whole"), 64).otherwise(0)
    )
    place = ["id"] if asked is None else ["id", "word"]
    per_word = hits.select("id", "word", bits.alias("bits")).repartition(tasks, *place).groupBy("id", "word").agg(F.bit_or("bits").alias("bits"))
    if asked is None:
        pairs = per_word.join(sized(slots), "word")
    else:
        wanted = asked.distinct().join(sized(slots), "qid").repartition(tasks, *place)
        pairs = per_word.join(wanted.hint("shuffle_hash"), ["id", "word"])
    at = F.col("slot") - first
    moved = F.call_function("shiftleft", F.col("bits").cast("long"), (at % WORDS_IN_LONG * WORD_BITS).cast("int"))
    longs = range(-(-(last - first) // WORDS_IN_LONG))
    return pairs.groupBy("id", "qid").agg(*[
        F.coalesce(F.bit_or(F.when(F.floor(at / WORDS_IN_LONG) == i, moved)), F.lit(0).cast("long")).alias(f"m{i}") for i in longs],
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))).alias("there"),
    )


def _runs(held: DataFrame, width: int) -> DataFrame:
    """Per query and document, the run of its words from the first of ``width`` on: ``words``, ``typos``, ``attribute``, ``exact``.

    A word is in the run if as many words as should be are before it, each counted ``times``, as often as the pair came.
    """
    shift = lambda name, value, by: F.call_function(name, value, by.cast("int"))
    longs = F.array(*[f"m{i}" for i in range(-(-width // WORDS_IN_LONG))])
    one = F.lit(1).cast("long")

    def inside(s: Column) -> Column:
        before = F.bit_count(F.col("there").bitwiseAND(shift("shiftleft", one, s) - 1)) * F.col("times")
        return (F.col("there").bitwiseAND(shift("shiftleft", one, s)) != 0) & (before <= s) & (before + F.col("times") > s)

    def part(s: Column) -> Column:
        bits = shift("shiftright", F.get(longs, F.floor(s / WORDS_IN_LONG).cast("int")), s % WORDS_IN_LONG * WORD_BITS)
        return bits.bitwiseAND(F.lit((1 << WORD_BITS) - 1).cast("long"))

    lowest = lambda p, at: F.when(F.shiftright(p, at).bitwiseAND(one) != 0, 0).when(F.shiftright(p, at + 1).bitwiseAND(one) != 0, 1).otherwise(2)
    total = lambda c: F.aggregate("run", F.lit(0).cast("long"), lambda n, p: n + c(p))
    slots = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), inside)
    return held.withColumn("run", F.transform(slots, part)).filter(F.size("run") > 0).select(
        "qid", "id", F.size("run").cast("long").alias("words"), total(lambda p: lowest(p, 0)).alias("typos"),
        F.array_min(F.transform("run", lambda p: lowest(p, 3))).alias("attribute"), total(lambda p: F.shiftright(p, 6)).alias("exact"),
    )


def _levels(found: DataFrame, top_k: int) -> DataFrame:
    """``(qid, level)``: the largest number of words that at least ``top_k`` documents have, or 1."""
    counted = found.groupBy("qid", "words").agg(F.count("*").alias("n"))
    longer = Window.partitionBy("qid").orderBy(F.desc("words"))
    reached = counted.withColumn("reached", F.sum("n").over(longer))
    return reached.groupBy("qid").agg(F.coalesce(F.max(F.when(F.col("reached") >= top_k, F.col("words"))), F.lit(1)).alias("level"))


def _kept(found: DataFrame, top_k: int) -> DataFrame:
    """The documents of each query's level."""
    return found.join(sized(cut_lineage(_levels(found, top_k))), "qid").filter("words >= level").drop("level")


def match_documents(queries: DataFrame, postings: DataFrame, documents: DataFrame,
                    typos: bool = True, top_k: int = TOP_K, prefix: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(answers, matches)``: index terms per query word, and the matching documents per query.

    ``answers`` is ``(qid, slot, word, term, typos, whole)``; ``word`` names the terms that answer it, in every query. With ``prefix`` a last word that the query ends with is also answered
    by every term that starts with it, without a typo but not as a ``whole`` word, which is what ``exact`` counts. ``matches`` has one row per query and
    document with every rule but proximity, which needs positions. Both are stored, since ranking, facets and
    snippets read them again.

    The first words of a query find its documents in the postings. Later words come in blocks that are looked up only for
    documents that have all earlier words. A pair of query and document is a few numbers whatever the number of terms.
    """
    slots = query_terms(queries).distinct()
    words = slots.select("word").distinct()
    looked_up = postings if typos or prefix else of_terms(postings, words.select(F.col("word").alias("term")))
    counts = cut_lineage(looked_up.groupBy("term").agg(F.count("*").alias("n")))
    vocabulary = counts.select("term")
    if typos:
        terms = match_terms(cut_lineage(words), vocabulary)
    else:
        terms = words.select("word", F.col("word").alias("term"), F.lit(0).alias("typos"))
    meant = terms.select("word", "term", "typos", (F.col("typos") == 0).alias("whole"))
    if prefix:
        # The word that a query ends with is a word of its own, with a star.
        meant, ends = cut_lineage(meant), last_words(queries).distinct().withColumn("ends", F.lit("*"))
        slots = cut_lineage(slots.join(ends, ["qid", "word"], "left").withColumn("said", F.concat("word", F.coalesce("ends", F.lit("")))))
        begins = cut_lineage(slots.filter("ends is not null").select("word", "said").distinct())
        longer = match_prefixes(cut_lineage(begins.select("word")), vocabulary).withColumn("whole", F.lit(False))
        # A term within a typo that also starts with the word counts as its start.
        begun = meant.unionByName(longer).join(sized(begins), "word").groupBy("said", "term").agg(
            F.min("typos").alias("typos"), F.max("whole").alias("whole")
        )
        meant = meant.unionByName(begun.withColumnRenamed("said", "word"))
        slots = slots.select("qid", "slot", F.col("said").alias("word"))
    meant, slots = cut_lineage(meant), cut_lineage(slots)
    answers = cut_lineage(slots.join(meant, "word").select("qid", "slot", "word", "term", "typos", "whole"))
    longest = slots.agg(F.max("slot") + 1).first()[0] or 0
    counts = cut_lineage(counts.join(sized(meant.select("term").distinct()), "term", "left_semi"))
    least = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def block(first: int, last: int) -> tuple[DataFrame, DataFrame, int]:
        some = cut_lineage(slots.filter((F.col("slot") >= first) & (F.col("slot") < last)))
        said = cut_lineage(meant.join(sized(some.select("word").distinct()), "word", "left_semi"))
        n_hits = said.join(sized(counts), "term").agg(F.sum("n")).first()[0] or 0
        return some, said, max(least, -(-n_hits // TASK_HITS))

    # The postings stay where they are: a checked number of answers is sent to them.
    asked, said, tasks = block(0, FIRST_WORDS)
    hits = _word_hits(postings, said).select("id", "word", "field", "typos", "whole")
    held = _admitted(documents, queries, _held(hits, asked, 0, FIRST_WORDS, tasks)).groupBy("id", "qid").agg(
        F.max("m0").alias("m0"), F.max("there").alias("there"), F.count("*").alias("times")
    )
    found = _kept(cut_lineage(_runs(held, FIRST_WORDS)), top_k)
    first = FIRST_WORDS
    while first < longest:
        last = first + LATER_WORDS
        going = cut_lineage(found.filter(F.col("words") == first).select("qid", "id"))
        if going.isEmpty():
            break
        asked, said, tasks = block(first, last)
        hits = _word_hits(postings, said, cut_lineage(going.select("id").distinct())).select("id", "word", "field", "typos", "whole")
        more = _runs(_held(hits, asked, first, last, tasks, going).withColumn("times", F.lit(1)), LATER_WORDS)
        more = more.toDF("qid", "id", "more_words", "more_typos", "more_attribute", "more_exact")
        plus = lambda c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c)
        found = _kept(cut_lineage(found.join(more, ["qid", "id"], "left").select(
            "qid", "id", plus("words"), plus("typos"), F.least("attribute", "more_attribute").alias("attribute"), plus("exact")
        )), top_k)
        first = last
    shown = documents.select("id", "url", "domain", "language", "rank_score")
    return answers, cut_lineage(shown.join(found, "id").select(
        "qid", "id", "words", "typos", "attribute", "exact", "url", "domain", "language", "rank_score"
    ))


def _proximity(candidates: DataFrame, answers: DataFrame, postings: DataFrame) -> DataFrame:
    """``(qid, id, saved)``: what the smallest distances of neighbouring words save against the full distance.

    Hits are dealt by document, once and as two numbers each: the document, and a word's number with its place. What a document has of
    the words of all queries is then one row, which meets the queries in that place; nothing is kept per query and hit. The nearest
    places of two words are next to each other when the places of both are put in order, so no pairs are formed.
    """
    # A single word has no neighbour.
    asked = cut_lineage(candidates.filter("words > 1").select("qid", "id", "words").distinct())
    reach = cut_lineage(asked.groupBy("qid").agg(F.max("words").alias("words")))
    slots = cut_lineage(answers.select("qid", "slot", "word").distinct().join(sized(reach), "qid").filter("slot < words").drop("words"))
    # One task numbers the different words of the queries.
    numbers = cut_lineage(slots.select("word").distinct().withColumn("n", F.row_number().over(Window.orderBy("word")).cast("long")))
    said = cut_lineage(slots.join(sized(numbers), "word").groupBy("qid").agg(F.collect_list(F.struct("slot", "n")).alias("said")))
    meant = cut_lineage(answers.select("word", "term").distinct().join(sized(numbers), "word").select("n", "term"))
    # Many documents are not looked up one by one: that would move the postings to them, and their hits are moved anyway.
    ids = cut_lineage(asked.select("id").distinct())
    hits = _word_hits(postings, meant, ids if small(ids) else None)
    least = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, -(-hits.count() // TASK_HITS))
    place = F.shiftleft(F.col("field").cast("long"), 32) + F.col("pos")
    dealt = hits.select("id", (F.shiftleft("n", PLACE_BITS) + place).alias("hit")).repartition(tasks, "id")
    per_word = dealt.groupBy("id", F.shiftright("hit", PLACE_BITS).alias("n")).agg(
        F.collect_list(F.col("hit").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))).alias("places")
    )
    held = per_word.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("n", "places"))).alias("held"))
    wanted = asked.join(sized(said), "qid").repartition(tasks, "id")

    def places_of(slot: Column) -> Column:
        """Places of a slot; a repeated query id may have several words in it."""
        found = F.transform(F.filter("said", lambda x: x["slot"] == slot), lambda x: F.try_element_at("held", x["n"]))
        return F.flatten(F.filter(found, lambda places: places.isNotNull()))

    def gap(one: Column, other: Column) -> Column:
        # The side is the last bit.
        both = F.sort_array(F.concat(F.transform(one, lambda p: p * 2), F.transform(other, lambda p: p * 2 + 1)))
        bit = F.lit(1).cast("long")
        steps = lambda m: F.transform(m, lambda x, i: F.when(
            x.bitwiseAND(bit) != F.get(m, i - 1).bitwiseAND(bit), F.shiftright(x, 1) - F.shiftright(F.get(m, i - 1), 1)
        ))
        return let(both, lambda m: F.least(F.array_min(steps(m)), F.lit(MAX_GAP).cast("long")))

    slots_of = F.transform(F.sequence(F.lit(0), (F.col("words") - 1).cast("int")), places_of)
    gaps = lambda s: F.transform(F.slice(s, 2, F.size(s) - 1), lambda places, i: gap(F.get(s, i), places))
    saved = F.aggregate(let(slots_of, gaps), F.lit(0).cast("long"), lambda n, g: n + g - MAX_GAP)
    return held.join(wanted.hint("shuffle_hash"), "id").select("qid", "id", saved.alias("saved"))


def rank(queries: DataFrame, answers: DataFrame, matches: DataFrame, postings: DataFrame,
         top_k: int = TOP_K) -> DataFrame:
    """The best ``top_k`` documents of each query with their place and all ranking values.

    Proximity is the third rule, so it can only order documents that tie on the first two.
    Documents with ``top_k`` better ones by those two are out before positions are read.
    """
    # Documents are counted per value of the first two rules. These tiers are few, so they
    # can be put in order per query where the documents, which may all tie, could not.
    tiers = matches.groupBy("qid", "words", "typos").agg(F.count("*").alias("n"))
    better = Window.partitionBy("qid").orderBy(F.desc("words"), "typos").rowsBetween(Window.unboundedPreceding, -1)
    open_tiers = cut_lineage(
        tiers.withColumn("ahead", F.coalesce(F.sum("n").over(better), F.lit(0))).filter(F.col("ahead") < top_k)
        .select("qid", "words", "typos")
    )
    candidates = cut_lineage(matches.join(sized(open_tiers), ["qid", "words", "typos"], "left_semi"))
    pairs = query_terms(queries).groupBy("qid").agg((F.count("*") - 1).alias("pairs"))
    scored = (
        candidates.join(_proximity(candidates, answers, postings), ["qid", "id"], "left")
        .join(sized(pairs), "qid")
        .withColumn("proximity", F.col("pairs") * MAX_GAP + F.coalesce("saved", F.lit(0)))
    )
    order = Window.partitionBy("qid").orderBy(
        F.desc("words"), "typos", "proximity", "attribute", F.desc("exact"), F.desc("rank_score"), "url", "id"
    )
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top_k).select(
        "qid", "place", "id", "url", "domain", "language", "words", "typos", "proximity", "attribute", "exact",
        "rank_score",
    )


def facets(matches: DataFrame) -> DataFrame:
    """``(qid, facet, value, n)``: matching documents per domain and per language."""
    named = F.array(
        F.struct(F.lit("domain").alias("facet"), F.col("domain").alias("value")),
        F.struct(F.lit("language").alias("facet"), F.col("language").alias("value")),
    )
    return matches.select("qid", F.inline(named)).filter("value is not null").groupBy("qid", "facet", "value").agg(
        F.count("*").alias("n")
    )


def facet_maps(counts: DataFrame) -> DataFrame:
    """One row per query with a map per facet, for display: of all values, however many; null for a facet without one.

    ``counts`` is what ``facets`` returns. A map is in one row, so one task holds the values of a query; a reader of rows takes ``facets``.
    """
    entry = F.struct("value", "n")
    one = lambda facet: let(
        F.array_sort(F.collect_list(F.when(F.col("facet") == facet, entry))),
        lambda entries: F.when(F.size(entries) > 0, F.map_from_entries(entries)),
    ).alias(facet)
    return counts.groupBy("qid").agg(one("domain"), one("language"))


def escape_html(content: Column) -> Column:
    for char, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]:
        content = F.replace(content, F.lit(char), F.lit(entity))
    return content


def snippet(body: Column, terms: Column, crop_words: int = CROP_WORDS, hit_pos: Column | None = None) -> Column:
    """Crop of ``body`` around its first found word, found words marked, the rest escaped.

    ``terms`` are the folded index terms to mark. A body without one is cropped from its start. What stands
    before the first word is a piece of its own. ``hit_pos`` is the first found word's position by the postings; only the words of
    the crop are then looked at, unless that word is not one of the terms, as after an edit of the body.
    """
    folded = lambda raw: text.fold(F.regexp_extract(raw, text.WORD, 0))

    def shown(raw: Column) -> Column:
        def marked(word: Column) -> Column:
            found = F.array_contains(terms, text.fold(word))
            said = F.when(found, F.concat(F.lit(PRE_TAG), word, F.lit(POST_TAG))).otherwise(word)
            return F.concat(said, escape_html(F.substr(raw, F.length(word) + 1)))

        return let(F.regexp_extract(raw, text.WORD, 0), marked)

    def cropped(pieces: Column) -> Column:
        scanned = F.coalesce(F.array_position(F.transform(pieces, lambda r: F.array_contains(terms, folded(r))), True), F.lit(0))
        hit = scanned
        if hit_pos is not None:
            # The piece before the first word has no position.
            place = (hit_pos + F.when(F.regexp_extract(F.get(pieces, F.lit(0)), text.WORD, 0) == "", 1).otherwise(0)).cast("int")
            right = F.array_contains(terms, folded(F.get(pieces, place - 1)))
            hit = F.when(hit_pos.isNotNull() & F.coalesce(right, F.lit(False)), place).otherwise(scanned)
        first = F.greatest(F.least(hit - crop_words // 2, F.size(pieces) - crop_words + 1), F.lit(1)).cast("int")
        return let(first, lambda start: F.concat(
            F.when(start > 1, F.lit(CROP_MARK)).otherwise(F.lit("")),
            F.rtrim(F.array_join(F.transform(F.slice(pieces, start, F.lit(crop_words)), shown), "")),
            F.when(F.size(pieces) > start + crop_words - 1, F.lit(CROP_MARK)).otherwise(F.lit("")),
        ))

    raw = F.regexp_extract_all(body, F.lit(rf"^[^\p{{L}}\p{{N}}]+|{text.WORD}[^\p{{L}}\p{{N}}]*"), F.lit(0))
    return let(raw, lambda pieces: F.when(F.size(pieces) == 0, F.lit("")).otherwise(cropped(pieces)))


def results(ranked: DataFrame, answers: DataFrame, documents: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """Result rows of ranked hits: url, title, snippet, meta description and score.

    An empty snippet falls back to the meta description. The hits are ``top_k`` per query;
    if few enough they are broadcast to the documents, so bodies are not shuffled, and
    either way other documents are dropped before their bodies are worked on. With ``postings`` the place of a crop
    is read from them, and not found by looking at every word of a body.
    """
    # The words to mark are those of the document's run; the dropped ones are not searched for.
    places = cut_lineage(ranked.select("qid", "place", "id", "rank_score", "words"))
    marks = cut_lineage(places.select("qid", "words").distinct().join(sized(answers), "qid").filter("slot < words").select(
        "qid", "words", "term"
    ).distinct())
    terms = marks.groupBy("qid", "words").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    hits = places.join(terms, ["qid", "words"])
    if postings is not None:
        asked = cut_lineage(places.select("qid", "id", "words").join(marks, ["qid", "words"]).select("qid", "id", "term"))
        body = postings.filter(F.col("field") == FIELDS.index("body_text")).join(sized(cut_lineage(asked.select("id").distinct())), "id", "left_semi")
        first = of_terms(body, asked).join(sized(asked), ["term", "id"]).groupBy("qid", "id").agg(F.min("pos").alias("hit_pos"))
        hits = hits.join(first, ["qid", "id"], "left")
    hits = cut_lineage(hits.drop("words"))
    found = documents.select("id", "url", "title", "meta_description", "body_text").join(sized(hits), "id")
    meta = F.coalesce("meta_description", F.lit(""))
    crop = snippet(F.coalesce("body_text", F.lit("")), F.col("terms"), hit_pos=None if postings is None else F.col("hit_pos"))
    shown = found.withColumn("crop", crop)
    return shown.select(
        "qid", "place", "url", F.coalesce("title", F.lit("")).alias("title"),
        F.when(F.col("crop") != "", F.col("crop")).otherwise(meta).alias("snippet"),
        meta.alias("meta_description"), "rank_score",
    )


def display(rows: DataFrame, message: str = "No description.") -> DataFrame:
    """What a result list shows: title or url; snippet, meta description or a message."""
    filled = lambda name: F.when(F.col(name) != "", F.col(name))
    return rows.select(
        "qid", "place", "url", F.coalesce(filled("title"), "url").alias("heading"),
        F.coalesce(filled("snippet"), filled("meta_description"), F.lit(message)).alias("summary"),
    )
