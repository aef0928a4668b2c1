import hashlib
from collections import Counter

import corpus_pipeline as P
import public_tokenizers
import tiktoken
from opsight.llm import bpe, linededup
from opsight.llm import mixing as M
from opsight.llm.common import materialise

from .conftest import closure, plain_simhash
from .test_linededup import brute as brute_lines

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_each_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash_dedup", "mixing", "bpe"]

    clean = materialise(P.STAGES[0][1](spark, docs, SF), "t")
    before, after = rows_of(docs), rows_of(clean)
    assert clean.columns == COLUMNS
    gone = set(before) - set(after)
    assert all(before[i] == after[i] for i in after)
    assert sum(labels.get(i) == 1 for i in gone) >= 0.9 * sum(v == 1 for v in labels.values())
    assert sum(labels.get(i) == 0 for i in gone) <= 0.02 * sum(v == 0 for v in labels.values())

    lines = materialise(P.STAGES[1][1](spark, clean, SF), "t")
    assert lines.columns == COLUMNS
    want = {i: t for i, _, t, _, _ in brute_lines([(r.doc_id, r.source, r.text) for r in after.values()], linededup.RATIO, linededup.MIN_PAGES)}
    got = rows_of(lines)
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())

    once = materialise(P.STAGES[2][1](spark, lines, SF), "t")
    assert once.columns == COLUMNS
    ids = sorted(got)
    fps = [plain_simhash(got[i].text, 3) for i in ids]
    links = [(i, j) for i in range(len(ids)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    assert sorted(rows_of(once)) == [ids[i] for i, r in enumerate(closure(len(ids), links)) if r == i]

    mix = materialise(P.STAGES[3][1](spark, once, SF), "t")
    assert mix.columns == COLUMNS
    left, drawn = rows_of(once), Counter(r.doc_id for r in mix.collect())
    assert set(drawn) <= set(left) and max(drawn.values()) == 1
    plan = {r.source: r for r in M.mixing_plan(once, P.BUDGET_SHARE, max_repeats=P.MAX_REPEATS).collect()}
    words = Counter()
    for i in drawn:
        words[left[i].source] += len(left[i].text.split())
    assert all(words[s] >= 0.95 * p.budget for s, p in plan.items())

    table = bpe.merge_table(bpe.read_file(public_tokenizers.path(P.RANKS)))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table.ids, special_tokens={})
    out = P.STAGES[4][1](spark, mix, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(drawn)
    for r in out:
        assert r.ids == library.encode_ordinary(left[r.doc_id].text) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(left[r.doc_id].text.encode()).hexdigest()


def test_planted_lines_go_from_a_source(spark):
    """Of a source of 400 documents; the default ratio of hosts drops none of the planted lines."""
    passage, notice, short = " ".join(f"p{i}" for i in range(60)), "all rights reserved by the owner of this", "Of that."
    rows = []
    for i in range(500):
        lines = [f"clean line {i} of words that nobody else has", " ".join(f"c{i}x{k}" for k in range(60)), "both alone of two documents here" * (i in (50, 51))]
        lines += [passage] * (i < 4) + [notice] * (10 <= i < 16) + [short] * (20 <= i < 36)
        rows.append((i, "\n".join(lines), "en", "large" if i < 400 else "other", 1))
    rows.append((600, passage, "en", "other", 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = rows_of(P.drop_boilerplate(spark, df, SF))
    assert {i: r.text for i, r in got.items()} == {r[0]: "\n".join(x for x in r[1].split("\n") if x != notice and (x != passage or r[3] == "other")) for r in rows}
