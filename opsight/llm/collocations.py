"""Phrase collocations by SETM relational mining.

Level k holds one relation of occurrences, sorted by piece and position, whose items are the frequent phrases of k words.
The merge-join of a relation with itself on piece and next position gives the candidates of level k + 1; they are counted by groups, and
the frequent groups are semi-joined with the candidates' relation, which is written before the next level reads it, until `max_words`.

A relation is a table with one row for each block of some 1,500,000 words: an array of items in the order of piece and position, with
a gap after each piece, so that "same piece, next position" is the next place and the merge-join needs no shuffle. Tables of
relations are bucketed by block, so the semi-join doesn't move them either. Shuffled are a block's distinct groups with their counts, not
occurrences: a phrase that makes a third of all words is one row of each block. A group's rows meet in one task, sorted, where they are counted
and frequent groups get small numbers; what is frequent goes back to its block, whose dictionary bounds what a task holds.

Any phrase inside a frequent phrase is frequent, so a phrase of k + 1 words is a pair of overlapping frequent phrases of k words:
groups are keyed by two ids, whatever their length. A piece longer than a block is cut; the words after a cut that phrases
before it need are repeated and not counted there.

Edge cases: a null text has no words; a null lang is `und` (and joins real `und` rows); repeated rows count each time; texts and pieces
have any length; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import itertools
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, shared_path

BLOCK_WORDS = 1_500_000
CODE_BITS, BLOCK_BITS = 24, 18  # an occurrence group's row: task, block of the task, code in the block
ENDS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(bytes(range(65, 91)) + ENDS, bytes(range(97, 123)) + b"\n" * len(ENDS))
NO_LANG = "und"
SALTS = 16

WORDS = "block long, items array<int>, halo array<int>, code array<int>, lang array<string>, word array<string>, n array<int>"
RELATION = "block long, items array<int>, halo array<int>, ids array<long>"
PAIRS = "uid long, left long, right long, n int"
LAST_PAIRS = "left long, right long, n int"


class _Block:
    """Words of some texts: items in order with -1 after each piece; codes by lang and word; `halo`: places that don't count."""

    def __init__(self):
        count = itertools.count()
        self.codes = defaultdict(lambda: defaultdict(count.__next__))
        self.items, self.halo = [], []

    def add(self, lang: str, words: list[bytes], counted: int) -> None:
        self.items.extend(map(self.codes[lang].__getitem__, words))
        self.halo.extend(range(len(self.items) - len(words) + counted, len(self.items)))
        self.items.append(-1)

    def batch(self, number: int) -> pa.RecordBatch:
        items = np.array(self.items, np.int32)
        words, langs, codes = [], [], []
        for lang, known in self.codes.items():
            words.extend(known)
            codes.extend(known.values())
            langs.extend([lang] * len(known))
        own = items.copy()
        own[self.halo] = -1
        n = np.bincount(own[own >= 0], minlength=len(words))[codes] if words else []
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), _one(items, pa.int32()), _one(self.halo, pa.int32()), _one(codes, pa.int32()), _one(langs, pa.string()),
             _one(pa.array(words, pa.binary()).cast(pa.string()), pa.string()), _one(n, pa.int32())],
            names=["block", "items", "halo", "code", "lang", "word", "n"])


def _one(values, kind: pa.DataType) -> pa.ListArray:
    """An arrow column of one row that holds the list `values`."""
    flat = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


def pieces_of(text: str):
    for piece in text.encode("utf-8", "surrogatepass").translate(_FOLD).split(b"\n"):
        if words := piece.split():
            yield words


def _word_blocks(max_words: int, size: int):
    def run(batches):
        number, block = TaskContext.get().partitionId() << BLOCK_BITS, _Block()
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for words in pieces_of(text or ""):
                    for i in range(0, len(words), size):
                        block.add(lang if isinstance(lang, str) else NO_LANG, words[i:i + size + max_words - 1], min(size, len(words) - i))
                        if len(block.items) >= size:
                            yield block.batch(number)
                            block, number = _Block(), number + 1
        if block.items:
            yield block.batch(number)

    return run


def _flat(column, i: int) -> np.ndarray:
    s = column[i]
    return s.values.to_numpy(zero_copy_only=False) if s.is_valid else np.zeros(0, np.int64)


def merge_join(items: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places whose item and whose next place's item are there, the code of the pair at each, and the distinct pairs of ids.

    Codes are the ranks of the pairs, so they are the same whenever they are computed.
    """
    at = np.flatnonzero((items[:-1] >= 0) & (items[1:] >= 0))
    m = max(1, len(ids))
    key = items[at].astype(np.int64) * m + items[at + 1]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.ones(len(at), bool)
    first[1:] = key[1:] != key[:-1]
    code = np.empty(len(at), np.int64)
    code[order] = np.cumsum(first) - 1
    key = key[first]
    return at, code, np.stack([ids[key // m], ids[key % m]])


def _relations(batches):
    """(block, relation) of each row of RELATION."""
    for b in batches:
        col = {n: b.column(n) for n in b.schema.names}
        for i in range(b.num_rows):
            yield col["block"][i].as_py(), {n: _flat(col[n], i) for n in col if n != "block"}


def _row(block: int, items: np.ndarray, halo: np.ndarray, codes: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """A relation whose items are places in `ids`, which ascend: items with a frequent code, -1 for the rest (the semi-join)."""
    order = np.argsort(ids)
    codes, ids = codes[order], ids[order]
    to = np.full(int(items.max(initial=-1)) + 2, -1, np.int32)  # the last place stands for -1, a gap
    to[codes] = np.arange(len(codes), dtype=np.int32)
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), _one(to[items], pa.int32()), _one(halo, pa.int32()), _one(ids, pa.int64())],
                                      names=["block", "items", "halo", "ids"])


def _frequent_words(batches):
    for block, r in _relations(batches):
        yield _row(block, r["items"], r["halo"], r["codes"], r["to"])


def _pairs(batches, numbered: bool = True):
    for block, r in _relations(batches):
        at, code, pairs = merge_join(r["items"], r["ids"])
        counted = np.ones(len(r["items"]), bool)
        counted[r["halo"]] = False
        n = np.bincount(code[counted[at]], minlength=pairs.shape[1]).astype(np.int32)
        cols = {"left": pa.array(pairs[0], pa.int64()), "right": pa.array(pairs[1], pa.int64()), "n": pa.array(n, pa.int32())}
        if numbered:
            cols = {"uid": pa.array((block << CODE_BITS) + np.arange(pairs.shape[1]), pa.int64())} | cols
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def _last_pairs(batches):
    """Pairs of the last level: nothing goes back to their blocks."""
    return _pairs(batches, numbered=False)


def _frequent_pairs(batches):
    for block, r in _relations(batches):
        at, code, _ = merge_join(r["items"], r["ids"])
        items = np.full(len(r["items"]), -1, np.int64)
        items[at] = code
        yield _row(block, items, r["halo"], r["codes"], r["to"])


class _Relation:
    """A relation's table, bucketed by block in the shared folder."""

    def __init__(self, rows: DataFrame):
        self.spark, self.name, path = rows.sparkSession, f"setm_{uuid.uuid4().hex}", shared_path(rows.sparkSession, "setm-relation")
        n = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        rows.write.format("parquet").bucketBy(n, "block").option("path", path).saveAsTable(self.name)
        self.rows = self.spark.table(self.name)
        self.rows._opsight_path = path

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        discard(self.rows)


def _numbered(least: int, bits: int, keys: list[str]):
    """mapInArrow body over rows (uid, keys, n) sorted by keys: the rows of frequent groups with a small id for each group."""
    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            c = t.column(k).combine_chunks()
            new |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        return np.r_[0, np.flatnonzero(new) + 1]

    def run(batches):
        task, count, held = TaskContext.get().partitionId(), 0, None
        if task >> bits:
            raise ValueError("more tasks than ids have room for")

        def rows(t: pa.Table, at: np.ndarray):
            nonlocal count
            total = np.add.reduceat(t.column("n").to_numpy().astype(np.int64), at)
            size, ok = np.diff(np.r_[at, t.num_rows]), total >= least
            first = np.zeros(t.num_rows, bool)
            first[at] = True
            kept = np.repeat(ok, size)
            ids = ((count + np.arange(ok.sum())) << bits) + task
            count += int(ok.sum())
            some, first = t.filter(pa.array(kept)), pa.array(first[kept])
            cols = {"uid": some.column("uid"), "id": pa.array(np.repeat(ids, size[ok]), pa.int64())}
            cols |= {k: pc.if_else(first, some.column(k), pa.scalar(None, some.column(k).type)) for k in keys}
            cols["f"] = pc.if_else(first, pa.array(np.repeat(total[ok], size[ok]), pa.int64()), pa.scalar(None, pa.int64()))
            yield from pa.table(cols).combine_chunks().to_batches()

        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            if t.num_rows:
                at = starts(t)
                held = t.slice(int(at[-1]))  # its group may go on in the next batch
                if at[-1]:
                    yield from rows(t.slice(0, int(at[-1])), at[:-1])
        if held is not None:
            yield from rows(held, np.zeros(1, np.int64))

    return run


def _counted(groups: DataFrame, key: list[str], least: int) -> DataFrame:
    """The rows of groups with `least` occurrences and more: uid and id, and on one row of each group its key and f; written.

    A group has one row a block at most, so the rows of one group are few beside a task's others.
    """
    n = max(1, int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kinds = {f.name: f.dataType.simpleString() for f in groups.schema.fields}
    out = "uid long, id long, " + ", ".join(f"{k} {kinds[k]}" for k in key) + ", f long"
    dealt = groups.select("uid", *key, "n").repartition(n, *key).sortWithinPartitions(*key)
    return materialise(dealt.mapInArrow(_numbered(least, (8 * n).bit_length(), key), out), "setm-frequent")


def _semi_join(relation: _Relation, kept: DataFrame, extend) -> _Relation:
    """The relation of the next step: `extend` gets each block with the codes of its frequent groups and their ids."""
    by_block = (kept.select(F.shiftright("uid", CODE_BITS).alias("block"), F.col("uid").bitwiseAND((1 << CODE_BITS) - 1).cast("int").alias("code"), "id")
                .groupBy("block").agg(F.collect_list(F.struct("code", "id")).alias("g")))
    columns = [c for c in ("block", "items", "halo", "ids") if c in relation.rows.columns]
    met = (relation.rows.select(*columns).hint("merge").join(by_block, "block")
           .select(*columns, F.col("g.code").alias("codes"), F.col("g.id").alias("to")))
    out = _Relation(met.mapInArrow(extend, RELATION))
    relation.drop()
    return out


def phrase_levels(df: DataFrame, lang_col: str = "lang", text_col: str = "text", max_words: int = 3, least: int = 10,
                  block_words: int = BLOCK_WORDS) -> tuple[list[DataFrame], DataFrame]:
    """([frequent phrases of 1, 2, ... max_words words], words of each lang).

    Words: id, lang, word, f. Phrases: id, lang, parts (ids of the words), f, prefix_f and suffix_f (counts of the first and of the last
    1, 2, ... words), left and right (ids of the phrases without the last and without the first word). `with_text` spells them out.
    """
    src = df.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    relation = _Relation(src.mapInArrow(_word_blocks(max_words, block_words), WORDS))
    groups = (relation.rows.select("block", F.explode(F.arrays_zip("code", "lang", "word", "n")).alias("g"))
              .select((F.shiftleft("block", CODE_BITS) + F.col("g.code")).alias("uid"), "g.lang", "g.word", "g.n"))
    totals = materialise(groups.groupBy("lang").agg(F.sum("n").cast("long").alias("n")), "setm-totals")
    kept, extend = _counted(groups, ["lang", "word"], least), _frequent_words
    words = kept.where("f is not null").select("id", "lang", "word", "f")
    levels, none = [words], F.array().cast("array<long>")
    shorter = words.select("id", "lang", F.array("id").alias("parts"), "f", none.alias("prefix_f"), none.alias("suffix_f"))
    for size in range(2, max_words + 1):
        relation, extend = _semi_join(relation, kept, extend), _frequent_pairs
        if size < max_words:
            kept = _counted(relation.rows.mapInArrow(_pairs, PAIRS), ["left", "right"], least)
            found = kept.where("f is not null").select("id", "left", "right", "f")
        else:
            counts = relation.rows.mapInArrow(_last_pairs, LAST_PAIRS).groupBy("left", "right").agg(F.sum("n").cast("long").alias("f"))
            found = counts.where(F.col("f") >= least).select(F.lit(None).cast("long").alias("id"), "left", "right", "f")
        left = shorter.select(F.col("id").alias("left"), "lang", F.col("parts").alias("head"), F.concat("prefix_f", F.array("f")).alias("prefix_f"))
        right = shorter.select(F.col("id").alias("right"), F.element_at("parts", -1).alias("tail"), F.concat("suffix_f", F.array("f")).alias("suffix_f"))
        shorter = materialise(found.join(left, "left").join(right, "right").select(
            "id", "left", "right", "lang", F.concat("head", F.array("tail")).alias("parts"), "f", "prefix_f", "suffix_f"), "setm-level")
        levels.append(shorter)
    relation.drop()
    return levels, totals


def with_text(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """`phrases` with `phrase`, the words of `parts` joined by a space."""
    spelt = (phrases.select("parts").distinct().select("parts", F.posexplode("parts").alias("at", "id")).join(words.select("id", "word"), "id")
             .groupBy("parts").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase")))
    return phrases.join(spelt, "parts")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (l * r)), exact: 38 digits hold counts to 10^15."""
    big = lambda c: c.cast("decimal(19,0)")
    top = (big(a) * big(a)).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), (big(left) * big(right)).cast("decimal(38,0)"))


def collocations(df: DataFrame, lang_col: str = "lang", text_col: str = "text", max_words: int = 3, least: int = 10, inside: int = 50, top: int = 2000,
                 block_words: int = BLOCK_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of 2 to max_words words of each lang.

    A phrase is left out if a longer frequent phrase that holds it has `inside` per cent of its occurrences.
    """
    levels, totals = phrase_levels(df, lang_col, text_col, max_words, least, block_words)
    scored = []
    for k in range(1, max_words):
        level = levels[k].withColumnRenamed("f", "a")
        if k + 1 < max_words:
            # Of all longer phrases around this one, none is more frequent than the best with one word more.
            longer = levels[k + 1]
            around = (longer.select(F.explode(F.array("left", "right")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("around")))
            level = level.join(around, "id", "left").where(F.coalesce(100 * F.col("around") < inside * F.col("a"), F.lit(True)))
        cuts = [F.struct(_score(F.col("a"), F.col("prefix_f")[j - 1], F.col("suffix_f")[k - j]).alias("score"), F.lit(j).alias("cut"),
                         F.col("prefix_f")[j - 1].alias("l"), F.col("suffix_f")[k - j].alias("r")) for j in range(1, k + 1)]
        scored.append(level.select("lang", "parts", "a", F.array_min(F.array(*cuts)).alias("c")))
    every = scored[0]
    for s in scored[1:]:
        every = every.unionByName(s)
    # Ranks by numbers first, ties kept, so that only what can be among the best is spelt out. A lang may have a third of all
    # phrases: the best of each of its parts come first, so that its last task reads SALTS * top rows (and ties).
    numbers = [F.desc("c.score"), F.desc("a")]
    part = every.withColumn("part", F.pmod(F.xxhash64("parts"), F.lit(SALTS)))
    first = part.withColumn("r", F.rank().over(Window.partitionBy("lang", "part").orderBy(*numbers))).where(F.col("r") <= top)
    best = first.withColumn("r", F.rank().over(Window.partitionBy("lang").orderBy(*numbers))).where(F.col("r") <= top).drop("part", "r")
    spelt = with_text(materialise(best, "setm-best"), levels[0])
    ranked = spelt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*numbers, "phrase"))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "c.l", "c.r", "n", "c.score")


def collocations_sql(max_words: int = 3, least: int = 10, inside: int = 50, top: int = 2000) -> str:
    """The same for `documents` in DuckDB: every phrase counted, without the level-wise search."""
    words = lambda k: ", ".join(f"w[i + {j}]" for j in range(k))
    counted = "\nunion all ".join(
        f"select lang, {k} as k, array_to_string([{words(k)}], ' ') as phrase, [{words(k)}] as ws, count(*) as f "
        f"from (select lang, w, unnest(range(1, len(w) - {k - 2})) as i from pieces where len(w) >= {k}) group by all" for k in range(1, max_words + 1))
    cuts = "\nunion all ".join(
        f"select c.lang, c.phrase, c.ws, c.k, c.f as a, x.f as l, y.f as r, {j} as cut, "
        f"(1000000::hugeint * c.f * c.f) // (x.f::hugeint * y.f) as score from cand c "
        f"join counted x on x.lang = c.lang and x.k = {j} and x.phrase = array_to_string(c.ws[1:{j}], ' ') "
        f"join counted y on y.lang = c.lang and y.k = c.k - {j} and y.phrase = array_to_string(c.ws[{j + 1}:], ' ') where c.k > {j}" for j in range(1, max_words))
    return f"""
with pieces as (
  select lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') as w
  from (select coalesce(lang, '{NO_LANG}') as lang, unnest(string_split_regex(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents)),
counted as ({counted}),
totals as (select lang, sum(f)::bigint as n from counted where k = 1 group by lang),
cand as (select * from counted where k > 1 and f >= {least}),
cuts as ({cuts}),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
held as (
  select distinct s.lang, s.phrase from (select lang, f, k, ws, unnest(range(2, k)) as n from cand) x
  cross join unnest(range(1, x.k - x.n + 2)) as p(i)
  join cand s on s.lang = x.lang and s.k = x.n and s.phrase = array_to_string(x.ws[p.i:p.i + x.n - 1], ' ') where 100 * x.f >= {inside} * s.f),
kept as (select b.* from best b anti join held h on h.lang = b.lang and h.phrase = b.phrase),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score
from ranked join totals using (lang) where rank <= {top}
"""
