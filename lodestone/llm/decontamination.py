"""Benchmark decontamination over a distributed positional inverted index.

The index stores a posting ``(row_id, pos, term)`` for every training token
whose term occurs in the benchmark, and one closing posting per document that
holds its length. Phrases are found as alignments of an item with a document:
the two rarest terms of each item window (by their counts in the index) are
intersected after subtracting their offsets, so every surviving pair names the
one shift at which the item can lie over the document. Only there are the
remaining postings fetched; runs of consecutive matches as long as a window are
exact phrase matches. Work grows with the postings of rare terms and with true
matches, not with pairs of documents and items.

Proximity matches are windows of an item that a document holds with small changes:
the two rarest known terms of a window stand within ``SLOP`` words of their distance
in the item, and eight tenths (``NEAR_TENTHS``) of its words within ``SLOP`` words of
their places, as these two put them. They are found from the same lists, with the
offsets of the second term, and of the other words, widened by the slop.

Everything is DataFrame code. The vocabulary and the anchors are broadcast only
after a count has shown them to be small; otherwise the joins are shuffled.

Defined results: a null or empty text or item has no words, hence no hits; an
item shorter than a window is one window; a window of fewer than two words known to the
index has no proximity match; rows that repeat a ``doc_id`` are
separate rows of the result; equal item ids are one item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.text import NON_WORD, ascii_lower, split_words
from lodestone.llm.workspace import discard, fresh, hinted, materialise, settled, table

#: Words by which a word of a proximity match may be out of place, and tenths of a window's words that have to be there.
SLOP, NEAR_TENTHS = 3, 8
#: Term of the closing posting; no word is empty.
END = ""


def benchmark_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, variant, n_terms, at, term`` for every word of every item.

    Rows with the same id are variants of one item and are matched apart.
    """
    words = split_words(ascii_lower(F.col(text_col)), NON_WORD)
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words.alias("words"))
    rows = rows.where(F.size("words") > 0).distinct().withColumn("variant", F.xxhash64("item", F.array_join("words", " ")))
    return rows.select("item", "variant", F.size("words").alias("n_terms"), F.posexplode("words").alias("at", "term"))


def build_index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Positional postings of ``docs`` for the vocabulary of ``terms``, in the shared folder.

    Columns: ``row_id, pos, term`` and, in closing postings (``term`` is empty,
    ``pos`` the number of words), ``doc_id`` and ``text_md5``.
    """
    vocabulary = materialise(terms.select("term").distinct().union(docs.sparkSession.createDataFrame([(END,)], "term string")), "vocabulary")
    text = F.col(text_col)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col(id_col).alias("doc_id"),
        F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("text_md5"),
        F.array_append(split_words(ascii_lower(text), NON_WORD), END).alias("words"),
    )
    tokens = rows.select("row_id", "doc_id", "text_md5", F.posexplode("words").alias("pos", "term"))
    kept = tokens.join(hinted(vocabulary, 64), "term", "left_semi")
    last = F.col("term") == END
    index = materialise(
        kept.select("row_id", "pos", "term", F.when(last, F.col("doc_id")).alias("doc_id"), F.when(last, F.col("text_md5")).alias("text_md5")), "postings"
    )
    discard(vocabulary)
    return index


def anchors(terms: DataFrame, index: DataFrame, window: int, whole: bool = True) -> DataFrame:
    """For each item, the pairs of rarest terms of its windows and the stretch each pair serves.

    whole: leave out windows with a term that the index doesn't have; else those with fewer than two that it has.
    """
    counts = index.where(F.col("term") != END).groupBy("term").agg(F.count("*").alias("freq"))
    length = F.least(F.lit(window), F.col("n_terms"))
    counted = terms.join(counts, "term")
    first = F.greatest(F.lit(0), F.col("at") - length + 1)
    spread = counted.withColumn("start", F.explode(F.sequence(first, F.least(F.col("at"), F.col("n_terms") - length))))
    one = Window.partitionBy("variant", "start")
    ranked = spread.withColumn("rank", F.row_number().over(one.orderBy("freq", "at"))).withColumn("seen", F.count("*").over(one))
    known = F.col("seen") == length if whole else F.col("seen") >= 2
    pair = ranked.where(known & (F.col("rank") <= 2)).groupBy("item", "variant", "n_terms", "start").agg(
        F.min_by(F.struct("at", "term"), "rank").alias("a"), F.max_by(F.struct("at", "term"), "rank").alias("b")
    )
    keys = ["item", "variant", "n_terms", F.col("a.at").alias("at_a"), F.col("a.term").alias("term_a"), F.col("b.at").alias("at_b"), F.col("b.term").alias("term_b")]
    if not whole:  # the windows of a stretch may have gaps
        return pair.groupBy(*keys).agg(F.sort_array(F.collect_list("start")).alias("starts"))  # as many as a window has words
    return pair.groupBy(*keys).agg(F.min("start").alias("low"), (F.max("start") + F.least(F.lit(window), F.first("n_terms")) - 1).alias("high"))


def _paired(index: DataFrame, pairs: DataFrame, slop: int) -> DataFrame:
    """Alignments at which both anchors of a pair occur, the second within ``slop`` words of its place."""
    rare = pairs.select("term_a").union(pairs.select("term_b")).distinct()
    hits = index.join(hinted(rare, 64), F.col("term") == F.col("term_a"), "left_semi").select("row_id", "pos", "term")
    lead = hits.join(hinted(pairs, 256), F.col("term") == F.col("term_a")).withColumn("shift", F.col("pos") - F.col("at_a")).drop("pos", "term")
    lead = lead.withColumn("place", F.col("shift") + F.col("at_b"))
    follow = hits.select(F.col("row_id").alias("row_b"), _widened(slop).alias("pos_b"), F.col("term").alias("term_2"))
    same = (F.col("row_id") == F.col("row_b")) & (F.col("term_b") == F.col("term_2")) & (F.col("pos_b") == F.col("place"))
    return lead.join(follow if slop == 0 else follow.distinct(), same)


def _widened(slop: int) -> Column:
    """The places from ``pos - slop`` to ``pos + slop``, a row each."""
    return F.explode(F.array(*[F.col("pos") + d for d in range(-slop, slop + 1)]))


def phrase_hits(index: DataFrame, terms: DataFrame, window: int = 10) -> DataFrame:
    """``row_id, pos, item``: document words inside an occurrence of an item window."""
    pairs = materialise(anchors(terms, index, window), "anchors")
    length = F.least(F.lit(window), F.col("n_terms"))
    aligned = _paired(index, pairs, 0).where(F.col("shift") + F.col("high") - length + 1 >= 0)  # the document may begin after the first windows of a stretch
    stretch = aligned.select("row_id", "item", "variant", "n_terms", "shift", F.explode(F.sequence("low", "high")).alias("at")).distinct()
    wanted = stretch.join(hinted(terms.select("variant", "at", "term").distinct(), 96), ["variant", "at"]).withColumn("pos", F.col("shift") + F.col("at"))
    wanted = materialise(wanted, "aligned")
    rows = materialise(wanted.select("row_id").distinct(), "aligned_rows")
    there = index.join(hinted(rows, 16), "row_id", "left_semi").select("row_id", "pos", "term")
    found = wanted.join(there, ["row_id", "pos", "term"])
    line = Window.partitionBy("row_id", "variant", "shift")
    runs = found.withColumn("run", F.col("at") - F.row_number().over(line.orderBy("at")))
    kept = runs.withColumn("run_length", F.count("*").over(Window.partitionBy("row_id", "variant", "shift", "run")))
    return kept.where(F.col("run_length") >= F.least(F.lit(window), F.col("n_terms"))).select("row_id", "pos", "item")


def proximity_hits(index: DataFrame, terms: DataFrame, window: int = 10, slop: int = SLOP, tenths: int = NEAR_TENTHS) -> DataFrame:
    """``row_id, item, n_near``: how many windows of the item the document holds, at least about."""
    pairs = materialise(anchors(terms, index, window, whole=False), "anchors")
    seeds = materialise(_paired(index, pairs, slop).select("row_id", "item", "variant", "n_terms", "shift", F.explode("starts").alias("start")).distinct(), "seeds")
    rows = materialise(seeds.select("row_id").distinct(), "seed_rows")
    there = index.join(hinted(rows, 16), "row_id", "left_semi").select("row_id", "term", _widened(slop).alias("place")).distinct()
    length = F.least(F.lit(window), F.col("n_terms"))
    wanted = seeds.withColumn("at", F.explode(F.sequence(F.col("start"), F.col("start") + length - 1)))
    wanted = wanted.join(hinted(terms.select("variant", "at", "term").distinct(), 96), ["variant", "at"]).withColumn("place", F.col("shift") + F.col("at"))
    found = wanted.join(there, ["row_id", "term", "place"]).groupBy("row_id", "item", "variant", "n_terms", "shift", "start").agg(F.count("*").alias("n"))
    near = found.where(10 * F.col("n") >= tenths * length)
    return near.select("row_id", "item", "variant", "start").distinct().groupBy("row_id", "item").agg(F.count("*").alias("n_near"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Per document row: ``doc_id, text_md5, n_words, n_hit, n_items, items_sha256, contaminated, n_near, n_near_items``.

    n_near, n_near_items: windows, and items, that the document holds exactly or at least about.
    """
    return settled(docs.sparkSession, "contamination", lambda: _contamination(docs, items, window))


def _contamination(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    terms = materialise(benchmark_terms(items), "terms")
    index = build_index(docs, terms)
    hits = materialise(phrase_hits(index, terms, window), "hits")
    words = hits.select("row_id", "pos").distinct().groupBy("row_id").agg(F.count("*").alias("n_hit"))
    named = hits.select("row_id", "item").distinct().groupBy("row_id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    near = proximity_hits(index, terms, window).groupBy("row_id").agg(F.sum("n_near").alias("n_near"), F.count("*").alias("n_near_items"))
    ends = index.where(F.col("term") == END).select("row_id", "doc_id", "text_md5", F.col("pos").cast("long").alias("n_words"))
    found = words.join(named, "row_id").join(near, "row_id", "full")
    listed = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return ends.join(found, "row_id", "left").select(
        "doc_id",
        "text_md5",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.coalesce("n_near_items", F.lit(0)).cast("long").alias("n_near_items"),
    )


def _exactly_hit(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    terms = materialise(benchmark_terms(items), "terms")
    index = build_index(docs, terms)
    rows = materialise(phrase_hits(index, terms, window).select("row_id").distinct(), "hit_rows")
    return index.where(F.col("term") == END).join(hinted(rows, 16), "row_id", "left_semi").select("doc_id", "text_md5").distinct()


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the rows that hold an occurrence of an item window."""
    bad_id, bad_md5, md5 = fresh(docs, "bad_id"), fresh(docs, "bad_md5"), fresh(docs, "md5")
    bad = settled(docs.sparkSession, "contaminated", lambda: _exactly_hit(docs, items, window)).select(F.col("doc_id").alias(bad_id), F.col("text_md5").alias(bad_md5))
    same = F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.col(md5) == F.col(bad_md5))
    keyed = docs.withColumn(md5, F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return keyed.join(bad, same, "left_anti").drop(md5)


def op3_decontamination(spark, sf_dir):
    """Contamination of every document by the whole benchmark."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_md5")


ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w,
         row_number() OVER () AS r FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0
), item_windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)
), lengths AS (SELECT DISTINCT n FROM sized
), doc_windows AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths)
), found AS (SELECT d.r, d.n, d.i, b.item_id FROM doc_windows d JOIN item_windows b USING (n, win)
), hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r
), named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY r
), tokens AS (SELECT r, unnest(w) AS term, unnest(range(len(w))) AS pos FROM words
), item_terms AS (SELECT v, item_id, len(w) AS n_terms, n, unnest(w) AS term, unnest(range(len(w))) AS loc FROM (SELECT *, row_number() OVER () AS v FROM (SELECT DISTINCT item_id, w, n FROM sized))
), vocabulary AS (SELECT DISTINCT term FROM item_terms
), freqs AS (SELECT term, count(*) AS freq FROM tokens SEMI JOIN vocabulary USING (term) GROUP BY term
), spread AS (SELECT v, n, term, loc, freq, unnest(range(greatest(0, loc - n + 1), least(loc, n_terms - n) + 1)) AS start FROM item_terms JOIN freqs USING (term)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY v, start ORDER BY freq, loc) AS rank, count(*) OVER (PARTITION BY v, start) AS seen FROM spread
), pairs AS (SELECT a.v, a.n, a.start, a.loc AS at_a, a.term AS term_a, b.loc AS at_b, b.term AS term_b FROM ranked a JOIN ranked b ON a.v = b.v AND a.start = b.start AND a.rank = 1 AND b.rank = 2
), listed AS (SELECT tokens.* FROM tokens SEMI JOIN vocabulary USING (term)
), seeds AS (
  SELECT DISTINCT a.r, v, n, start, a.pos - at_a AS shift FROM pairs JOIN listed a ON a.term = term_a JOIN listed b ON b.r = a.r AND b.term = term_b AND abs(b.pos - (a.pos - at_a + at_b)) <= 3
), about AS (
  SELECT DISTINCT s.r, s.v, s.n, s.start, s.shift, i.loc FROM seeds s JOIN item_terms i ON i.v = s.v AND i.loc >= s.start AND i.loc < s.start + s.n
  JOIN listed t ON t.r = s.r AND t.term = i.term AND abs(t.pos - (s.shift + i.loc)) <= 3
), near_windows AS (SELECT DISTINCT r, v, start FROM (SELECT r, v, n, start, shift FROM about GROUP BY ALL HAVING 10 * count(*) >= 8 * n)
), near AS (SELECT r, count(*) AS n_near, count(DISTINCT item_id) AS n_near_items FROM near_windows JOIN (SELECT DISTINCT v, item_id FROM item_terms) USING (v) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0, false) AS contaminated,
       coalesce(n_near, 0) AS n_near, coalesce(n_near_items, 0) AS n_near_items
FROM words LEFT JOIN hit USING (r) LEFT JOIN named USING (r) LEFT JOIN near USING (r)
"""
