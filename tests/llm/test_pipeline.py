"""The whole pipeline against brute force on a small folder of tables."""

from __future__ import annotations

import random
import zlib

import duckdb
import numpy as np

import corpus_pipeline
from weftgraph.llm import oracles, tokens

ITEM = "we know that a box of twelve red apples weighs as much as nine green pears do"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables():
    """Rows (documents, ids that stay up to the mix): short, repetitive, copied, near and leaking texts go."""
    r = random.Random(6)
    rows, stay = [], []
    for i in range(60):
        w = [f"w{r.randrange(5000)}" for _ in range(r.choice([12, 60, 120]))]
        rows.append((i, " ".join(w), "en", r.choice(["a", "b", "c", None]), 1))
        stay.append(i)
    long = next(x for x in rows if len(x[1].split()) == 120)
    words = long[1].split()
    rows += [(100, long[1], "en", "a", 1), (101, " ".join([*words[:-1], "other"]), "en", "b", 1)]  # a copy and a near copy
    rows += [(200, "too short", "en", "a", 1), (201, "same words again " * 40, "en", "a", 1), (202, None, "en", "a", 0), (203, "", None, None, 0)]
    rows += [(300, f"{rows[3][1]} x {' '.join(f'u{k}' for k in range(80))} {ITEM} and more", "en", "c", 1)]
    return rows, stay


def test_pipeline(spark, tmp_path):
    rows, stay = tables()
    for name, data, schema in (
        ("documents", rows, SCHEMA),
        ("labels", [(1, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int"),
        ("benchmark", [(1, ITEM), (2, None)], "item_id long, text string"),
    ):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = sorted((tuple(x) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=lambda x: x[1])

    kept = [x for x in rows if x[0] in stay]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", kept)
    copies = {i: taken // size for i, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({oracles.OP1})").fetchall()}
    tok = tokens.Encoder(tokens.public_tokenizer()).tok
    want, at = [], 0
    for i, text, *_ in kept:
        ids = [*tok.encode(text, add_special_tokens=False).ids, 0]
        for _ in range(copies[i]):
            want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
    assert got == want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "decontamination", "mixing", "token_output"]
