"""The pipeline end to end on a small corpus, and the SQL of the operators that have it."""

from __future__ import annotations

import random
import struct
import zlib

import pytest

import corpus_pipeline
from pressloom.llm import lines, queries
from pressloom.llm.common import staged
from tests.compare import duck, duck_rows, rows_of
from tests.llm.test_operators import WORDS, folded, shingles

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_only_remove(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = staged(stage(spark, docs, SF))
        assert after.columns == docs.columns, name
        assert 0 < after.count() <= docs.count()
        assert after.join(docs, "doc_id", "left_anti").count() == 0
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


def plain_lines(rows):
    """(id, text) in id order less the lines that an earlier line repeats or is within one word of; documents left without words go."""
    first, order = {}, []
    for i, t in rows:
        for k, line in enumerate(t.split("\n")):
            line = line.strip(" ")
            if len(line) >= lines.MIN_CHARS and line not in first:
                first[line] = (i, k)
                order.append((line, line.split(" ")))

    def near(a, b):
        if min(len(a), len(b)) < lines.NEAR_WORDS or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    gone = {b for n, (b, wb) in enumerate(order) for a, wa in order[:n] if near(wa, wb)}
    out = []
    for i, t in rows:
        kept = [x for k, x in enumerate(t.split("\n")) if len(x.strip(" ")) < lines.MIN_CHARS or (x.strip(" ") not in gone and first[x.strip(" ")] == (i, k))]
        if len(kept) == len(t.split("\n")) or any(not c.isspace() for x in kept for c in x):
            out.append((i, "\n".join(kept)))
    return out


def plain_one_of_each(rows):
    sets, kept, group = [(i, t, shingles(t)) for i, t in rows], [], {}
    for i, _, a in sets:
        mine = {group[j] for j, _, b in sets if j in group and a and b and len(a & b) * 5 >= 4 * len(a | b)}
        group[i] = min(mine, default=i)
        group.update({j: group[i] for j, g in group.items() if g in mine})
    for i, t, _ in sets:
        if group[i] == i:
            kept.append((i, t))
    return kept


def plain_clean(rows, items):
    windows = {tuple(w[k : k + 10]) for t in items for w in [folded(t)] for k in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))
    return [(i, t) for i, t in rows if not hit(folded(t))]


def test_the_pipeline_equals_plain_versions_of_its_stages(spark, tmp_path):
    """run() over a small corpus with near copies, repeated lines and benchmark passages, against plain Python from the classifier's verdicts on."""
    from tokenizers import Tokenizer

    from pressloom.llm import quality
    from pressloom.llm.tokens import tokenizer_path

    rng = random.Random(17)
    sentence = lambda n: " ".join(rng.choice(WORDS) for _ in range(n)) + "."
    base = [sentence(60) + "\n" + sentence(25) for _ in range(40)]
    rows = list(enumerate(base))
    rows += [(100 + k, base[k].replace(base[k].split(" ")[50], "changed", 1)) for k in range(5)] + [(200 + k, base[k] + "\n" + sentence(30)) for k in range(5, 9)]
    rows += [(300, sentence(20) + "\n" + base[20].split("\n")[1]), (301, base[30]), (302, sentence(40) + " " + " ".join(base[31].split(" ")[:12])), (303, ""), (304, None), (305, "!!! ### $$$ " * 30), (306, sentence(3000))]
    items = [(1, " ".join(base[31].split(" ")[:30])), (2, " ".join(base[33].split(" ")[5:40])), (3, "no such passage anywhere in here"), (4, None)]
    spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    good = {r["doc_id"] for r in quality.classify(spark.read.parquet(f"{tmp_path}/documents.parquet")).where("keep").collect()}
    assert len(good) >= 45 and not good & {303, 304, 305}
    want = plain_clean(plain_one_of_each(plain_lines(sorted((i, t) for i, t in rows if i in good))), [t for _, t in items])
    assert 20 < len(want) < len(good)
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    pieces = set()
    for i, t in want:
        x = tokenizer.encode(t, add_special_tokens=False).ids + [1]
        pieces |= {(i, k, len(x[k : k + 2048]), zlib.crc32(struct.pack(f"<{len(x[k : k + 2048])}I", *x[k : k + 2048])), len(x)) for k in range(0, len(x), 2048)}
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert {(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got} == pieces and len(got) == len(pieces)


def test_stages_take_awkward_tables(spark):
    """An empty table, and nulls, repeated rows and empty texts alone, go through every stage."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    for rows in ([], [(None, None, None, None, None), (1, "", "xx", "s", 0), (1, "", "xx", "s", 0), (2, None, None, "s", 5), (3, " \n ", "xx", None, 3)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert set(stage(spark, docs, SF).columns) == set(docs.columns)
            assert stage(spark, docs, SF).count() <= len(rows)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    assert rows_of(queries.QUERIES[name](spark, SF)) == duck_rows(duck(SF), queries.ORACLE_SQL[name])
