"""The registered queries of the corpus operators, on the smallest tables, against plain loops, the library or DuckDB."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

from seqloom.llm import components, extract, langid, queries, secrets, tokens, toxicity


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    return {r["doc_id"]: r["text"] or "" for r in rows}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(tokens.vocabulary())
    return lambda text, end: np.array([*made.encode(text, add_special_tokens=False).ids, end], dtype="<u4")


def ran(spark, sf_dir, name):
    return queries.QUERIES[name](spark, sf_dir)


def kinds(df):
    return dict(df.dtypes)


def test_op1(spark, sf_dir, documents):
    df = ran(spark, sf_dir, "op1_simhash")
    assert kinds(df) == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}
    fps = []
    for t in documents.values():
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    x = np.array(fps, dtype=np.uint64)
    roots = components.local_roots(len(x), *np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3, 1)))
    ids = list(documents)
    assert {tuple(r) for r in df.collect()} == {(i, f"{f:016x}", ids[r]) for i, f, r in zip(ids, fps, roots)}


def test_op2(spark, sf_dir):
    df = ran(spark, sf_dir, "op2_extract")
    assert kinds(df) == {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}
    got = df.collect()
    pages = {r["page_id"]: (r["url"], r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(got) == len(pages) and all(r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]][0] for r in got)
    # marginals page by page, each tree by itself
    model = extract.default_model()
    for r in got[:60]:
        tree = extract.parse(pages[r["page_id"]][1] or "")
        p, _, _ = extract.marginals(extract.Forest([tree]), model)
        assert r["text"] == "\n\n".join(t for n, t in tree.runs if p[n] >= 0.5)
        assert not re.search(r"<\w+[^>]*>|&nbsp;|[ \t]{2,}", r["text"]) and r["text"] == r["text"].strip()


def test_op3(spark, sf_dir, documents, library):
    df = ran(spark, sf_dir, "op3_tokens")
    assert kinds(df) == {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}
    want, at = set(), 0
    for i, t in documents.items():
        ids = library(t, 1)
        want.add((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert {tuple(r) for r in df.collect()} == want


def test_op4(spark, sf_dir, documents):
    df = ran(spark, sf_dir, "op4_secrets")
    assert kinds(df) == {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"}
    got = {r["doc_id"]: r for r in df.collect()}
    assert got.keys() == documents.keys()
    name = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])"
    assign = re.compile(name + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, t in documents.items():
        found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base = [s for _, _, s in sorted(found)]
        r = got[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s.startswith(k + ":") for s in base) for k in ("assign", "access", "hex"))
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert [s for s in spans if s.split(":")[0] in secrets.BASE] == base
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)


def test_op6(spark, sf_dir, documents, library):
    df = ran(spark, sf_dir, "op6_pack")
    assert kinds(df) == {c: "bigint" for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
    pieces, sequences = {}, {}
    for r in df.collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert pieces.keys() == documents.keys()
    for i, t in documents.items():
        ids, at = library(t, 2), 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for got in sequences.values():
        ends = np.cumsum([n for _, n in sorted(got)])
        assert [o for o, _ in sorted(got)] == [0, *ends[:-1].tolist()] and ends[-1] <= 4096
    used = sum(n for got in sequences.values() for _, n in got)
    assert used > 0.9 * 4096 * (len(sequences) - 1)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.sql(queries.ORACLE_SQL[name])
    df = ran(spark, sf_dir, name)
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    near = lambda rows, names: sorted(tuple(round(r[names.index(c)], 6) if isinstance(r[names.index(c)], float) else r[names.index(c)] for c in order) for r in rows)
    assert near(df.collect(), df.columns) == near(want.fetchall(), want.columns)


def test_op7_of_repeated_ids(spark, tmp_path):
    """Each row of a repeated vec_id is a query with its own results, in the query and in its SQL."""
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in rng.normal(size=8)]) for i in [*range(300), 0, 100, 100, 7, 7]]
    rows += [(0, rows[0][1]), (None, [1.0] * 8), (400, None), (401, [None] * 8), (500, [1.0, 2.0]), (600, [float("inf")] * 8)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got = sorted(tuple(r) for r in ran(spark, str(tmp_path), "op7_topk").select("query_id", "rank", "vec_id", "score").collect())
    assert got == sorted(con.sql("SELECT query_id, rank, vec_id, score FROM (" + queries.ORACLE_SQL["op7_topk"] + ")").fetchall())
    assert sum(r[0] == 100 for r in got) == 30 and sum(r[0] == 500 for r in got) == 0


def test_op8(spark, sf_dir, documents):
    df = ran(spark, sf_dir, "op8_langid")
    assert kinds(df) == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    got = {r["doc_id"]: r for r in df.collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lang = dict(tuple(r) for r in docs.select("doc_id", "lang").collect())
    assert got.keys() == documents.keys()
    # by the model that the same rows teach, one text at a time
    net = langid.train(langid.sample(docs, ~langid.held_out(4, 2)))
    responses = langid.Responses(net)
    for i, t in documents.items():
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i]["score"] <= 1
        if not any(c.isalpha() for c in t):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
        else:
            best, p = langid.predict(net, responses, [t.encode()])
            assert got[i]["lang_pred"] == net.langs[best[0]] and got[i]["score"] == pytest.approx(float(p[0]), abs=1e-4)
    held = [i for i, r in got.items() if r["held_out"] and lang[i] is not None and r["lang_pred"] != "und"]
    assert np.mean([got[i]["lang_pred"] == lang[i] for i in held]) > 0.9


def test_op10(spark, sf_dir, documents):
    df = ran(spark, sf_dir, "op10_toxicity")
    assert kinds(df) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    got = {r["doc_id"]: r for r in df.collect()}
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(toxicity.sample(docs, labels, ~toxicity.held_out(5, 0)))
    assert got.keys() == documents.keys()
    for i, t in documents.items():
        p = float(toxicity.probabilities(model, [t.encode()])[0]) if model else 0.0
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i]["score"] == pytest.approx(p) and got[i]["predicted"] == int(got[i]["score"] >= 0.5)


def test_pipeline(spark, sf_dir, library):
    """Every stage's documents are among its predecessor's; the ids at the end are those of the redacted texts."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and {r["doc_id"] for r in rows} <= texts.keys()
    whole = {}
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        whole.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    for i, got in whole.items():
        ids = library(secrets.masked(texts[i]), 2).tobytes()
        starts = sorted(s for s, _ in got)
        copies = starts.count(0)
        assert 1 <= copies <= 3 and all(ids[4 * s : 4 * s + len(x)] == x for s, x in got) and sum(len(x) for _, x in got) == copies * len(ids)
    at = {}
    for r in rows:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for got in at.values():
        assert [o for o, _ in sorted(got)] == [0, *np.cumsum([n for _, n in sorted(got)])[:-1].tolist()] and sum(n for _, n in got) <= 4096


ODD = "doc_id long, text string, lang string, source string, n_chars long, measures long, KEPT string, mix_row long, passes long, map_bucket long, ids long"


def test_pipeline_of_odd_and_empty_tables(spark, tmp_path):
    """Nulls in every column, blank and very long texts, repeated rows and clashing names go through every stage."""
    import corpus_pipeline

    prose = " ".join(f"Some word{i % 89} of text{i % 97}, and more." for i in range(200))
    rows = [(1, prose, "en", "a", 1, 1, "x", 1, 1, 1, 1)] * 3 + [(None, prose + " End of another.", None, None, None, None, None, None, None, None, None), (2, None, None, None, None, None, None, None, None, None, None)]
    rows += [(3, "", "en", "a", 0, 0, "", 0, 0, 0, 0), (4, " \n\t", "fr", "b", 3, 3, "y", 3, 3, 3, 3), (5, " ".join(f"long{i % 1009} text{i % 997}." for i in range(40_000)), "de", "b", 9, 9, "z", 9, 9, 9, 9)]
    odd = spark.createDataFrame(rows, ODD)
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == odd.columns
        docs = spark.createDataFrame(after.collect(), odd.schema)
    assert {r["doc_id"] for r in docs.collect()} <= {1, None, 5} and docs.count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 10
    odd.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("name", ["op1_simhash", "op3_tokens", "op4_secrets", "op5_quality", "op6_pack", "op8_langid", "op9_mix", "op10_toxicity"])
def test_queries_on_odd_and_empty_tables(spark, tmp_path, name):
    text = "a few words of a text that says hardly anything"
    rows = [(1, text, "en", "a", 1, 1, "x", 1, 1, 1, 1)] * 2 + [(None,) * 11, (None, text, None, None, None, None, None, None, None, None, None), (3, "", "en", "a", 0, 0, "", 0, 0, 0, 0), (4, "12 34", "fr", "b", 3, 3, "y", 3, 3, 3, 3)]
    odd = spark.createDataFrame(rows, ODD)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for at, docs, marks in (("odd", odd, labels), ("none", odd.limit(0), labels.limit(0))):
        docs.write.parquet(f"{tmp_path}/{at}/documents.parquet")
        marks.write.parquet(f"{tmp_path}/{at}/labels.parquet")
        got = ran(spark, f"{tmp_path}/{at}", name)
        assert got.count() == (6 if at == "odd" else 0)
