"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Each source is a queue of its documents in an order that a hash of the document shuffles, gone through
``PASSES`` times.  A document waits as packets of ``PACKET`` words at most; a packet's virtual finish time is
the source's cumulative words, the packet's included, over the source's target.  The packets of all sources
are range-sorted by it, and the mix is what the total budget of words reaches in that order: a running total
over the sorted ranges truncates it, and the packet at the cut is cut too.  As the targets add up to the
budget, the cut falls at virtual time 1 or so, and each source has had its target to within a packet.

Running totals need no single task: a source's order is cut into ranges of the hash, totals of the
ranges are summed over each source, and rows are summed within a range; the sorted queue likewise has a total
for each of its ranges.  The number of ranges follows the data and doesn't change the result.

Targets: sources share the budget by weight, but none more than ``PASSES`` times its size; the excess is
shared again.  The level at which a source fills up has a closed form over the sources sorted by it.

Defined cases: a null text has no words; a null source is a source, the last in order; documents without
words are in the result with nothing taken; equal ``doc_id``s are ordered by a hash of the text, equal rows are
interchangeable; an empty table gives an empty result; other columns pass through ``mixed``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm import shared

#: Weights of the sources in code point order, repeating; part of all words that the mix has; passes at most.
WEIGHTS, BUDGET, PASSES = (3, 1, 2), 1.5, 2
#: Words of a packet at most; documents that a range of the shuffled order holds, about.
PACKET, RANGE_ROWS = 256, 2000


def n_words(text: Column) -> Column:
    """Runs of other than ASCII white space: words start where such a character follows white space or nothing."""
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.filter(F.split(spaced, " "), lambda w: w != "")), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """_rid, doc_id, source, size and the place in the shuffled order of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Hashes in hexadecimal order like their bytes.
    identity = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text.cast("binary")))
    return docs.select("_rid", "doc_id", "source", n_words(text).alias("size"), F.md5(identity.cast("binary")).alias("_place"))


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, passes: int = PASSES) -> DataFrame:
    """source, source_size and target of each source; there may be many."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = shared.running(per, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)})
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("w", weight).withColumn("cap", F.col("source_size").cast("double") * passes).withColumn("level", F.col("cap") / F.col("w"))
    laid = shared.written(shared.running(capped, [F.col("level"), F.col("rank")], {"caps": F.col("cap"), "ws": F.col("w")}), "sources")
    whole = laid.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
    total, every = budget * (whole["size"] or 0), whole["w"] or 0.0
    # What all sources have had when this one is full.
    fill = F.col("caps") + F.col("cap") + F.col("level") * (F.lit(every) - (F.col("ws") + F.col("w")))
    filled = laid.withColumn("full", fill <= total)
    rest = filled.agg(F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).alias("cap"), F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).alias("w")).first()
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.lit(total - (rest["cap"] or 0.0)) * F.col("w") / F.lit(rest["w"] or 1.0))
    return filled.select("source", "source_size", target.alias("target"))


def _name(source: str = "source") -> Column:
    """A source's name with a mark, so that a null source, which has none, is told from all others."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))


def queue(sizes: DataFrame, goals: DataFrame, budget: float = BUDGET, passes: int = PASSES, packet: int = PACKET) -> DataFrame:
    """The packets in order of virtual finish time, each with the words that the budget reaches: _rid, pass, finish, place, name, words, taken."""
    rows, digits = sizes.count(), 1
    while 16**digits * RANGE_ROWS < rows and digits < 12:
        digits += 1
    laid = sizes.withColumn("range", F.substring("_place", 1, digits)).withColumn("name", _name())
    totals = laid.groupBy("name", "range").agg(F.sum("size").alias("range_size"))
    before = F.coalesce(F.sum("range_size").over(Window.partitionBy("name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = totals.select("name", "range", before.alias("before")).join(goals.select(_name().alias("name"), "source_size", "target"), "name")
    within = Window.partitionBy("name", "range").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    placed = laid.join(places, ["name", "range"]).withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0))).where("size > 0 and target > 0")
    piece = F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / packet).cast("int")))
    cut = placed.withColumn("pass", F.explode(F.array(*map(F.lit, range(passes))))).withColumn("piece", piece)
    stop = F.least(F.col("size"), (F.col("piece") + 1) * packet)
    finish = (F.col("start") + F.col("pass") * F.col("source_size") + stop) / F.col("target")
    packets = cut.select("_rid", "pass", finish.alias("finish"), F.substring("_place", 1, 16).alias("place"), "name", (stop - F.col("piece") * packet).alias("words"))
    words = sizes.agg(F.sum("size").alias("size")).first()["size"] or 0
    served = shared.running(packets, [F.col("finish"), F.col("place"), F.col("name")], {"served": F.col("words")})
    left = F.lit(int(budget * words + 1e-6)) - F.col("served")
    return served.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("words"), left)).cast("long"))


def digest(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, passes: int = PASSES) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    sizes, goals = _prepared(shared.numbered(docs), weights, budget, passes)
    taken = queue(sizes, goals, budget, passes).where("taken > 0").groupBy("_rid").agg(F.sum("taken").alias("taken"))
    named = goals.select(_name().alias("name"), "source_size", "target")
    whole = sizes.withColumn("name", _name()).join(named, "name").join(taken, "_rid", "left")
    return whole.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def _prepared(numbered: DataFrame, weights, budget: float, passes: int) -> tuple[DataFrame, DataFrame]:
    sizes = shared.written(sized(numbered.select("_rid", *(F.col(f"doc.{c}").alias(c) for c in ("doc_id", "source", "text")))), "sizes")
    return sizes, shared.written(targets(sizes, weights, budget, passes), "targets")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), F.lit(0)), F.lit(1), n.cast("int")), "")


def mixed(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, passes: int = PASSES) -> DataFrame:
    """The mix in the queue's order: a row of ``docs`` for each time that one is taken, at its last packet; its text is cut if the mix ends in it."""
    numbered = shared.numbered(docs)
    sizes, goals = _prepared(numbered, weights, budget, passes)
    taken = queue(sizes, goals, budget, passes).where("taken > 0").groupBy("_rid", "pass").agg(F.sum("taken").alias("taken"), F.max("finish").alias("finish"), F.first("place").alias("place"))
    entries = taken.join(sizes.select("_rid", "size"), "_rid")
    in_order = numbered.join(entries, "_rid").repartitionByRange("finish", "place", "pass").sortWithinPartitions("finish", "place", "pass")
    text = F.when(F.col("taken") < F.col("size"), first_words(F.col("doc.text"), F.col("taken"))).otherwise(F.col("doc.text"))
    return in_order.select(*shared.fields(docs, text=text))


#: The same in DuckDB's SQL.
SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce('=' || source, '') AS name, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS place FROM documents),
s AS (SELECT source, name, sum(size)::BIGINT AS source_size FROM d GROUP BY source, name),
r AS (SELECT *, ([3.0, 1.0, 2.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, 2 * source_size::DOUBLE AS cap FROM s),
f AS (SELECT *, sum(cap) OVER o + cap / w * (sum(w) OVER () - sum(w) OVER o) <= 1.5 * sum(source_size) OVER () AS is_full,
             (1.5 * sum(source_size) OVER ())::DOUBLE AS total FROM r
      WINDOW o AS (ORDER BY cap / w RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT name, source_size, total, CASE WHEN is_full THEN cap ELSE
             (total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) * w / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () END AS target FROM f),
e AS (SELECT d.*, t.source_size, t.target, t.total, sum(d.size) OVER (PARTITION BY d.name ORDER BY d.place ROWS UNBOUNDED PRECEDING) - d.size AS start
      FROM d JOIN t ON d.name = t.name),
p AS (SELECT *, unnest(generate_series(0, (size - 1) // 256)) AS piece FROM (SELECT *, unnest([0, 1]) AS pass FROM e WHERE size > 0 AND target > 0)),
q AS (SELECT rid, left(place, 16) AS place, name, total, (least(size, (piece + 1) * 256) - piece * 256)::BIGINT AS words,
             (start + pass * source_size + least(size, (piece + 1) * 256))::DOUBLE / target AS finish FROM p),
k AS (SELECT rid, greatest(0, least(words, floor(total + 1e-6)::BIGINT - (sum(words) OVER (ORDER BY finish, place, name ROWS UNBOUNDED PRECEDING) - words))) AS taken FROM q)
SELECT e.doc_id, e.size, e.source_size, e.target, coalesce(k.taken, 0)::BIGINT AS taken
FROM e LEFT JOIN (SELECT rid, sum(taken) AS taken FROM k GROUP BY rid) k ON k.rid = e.rid
"""
