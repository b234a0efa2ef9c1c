"""Manifests and proofs against a plain recursive tree."""
import hashlib
import zlib

import duckdb
from pyspark.sql import functions as F

from linkloom.llm import merkle, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes, at):
    """(root, siblings level by level) for the leaf at a place."""
    proof = []
    while len(nodes) > 1:
        proof.append([x for i, x in enumerate(nodes) if i // 3 == at // 3 and i != at])
        nodes, at = [h(*nodes[i:i + 3]) for i in range(0, len(nodes), 3)], at // 3
    return nodes[0], proof


def brute(rows):
    """A sorted list of (doc_id, leaf, subroot, root, proof digest)."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    leaves = {s: sorted(((r[0] is not None, r[0] or 0, leaf(r)) for r in rows if r[1] == s)) for s in sources}
    subroots = [climb([x[2] for x in leaves[s]], 0)[0] for s in sources]
    out = []
    for place, s in enumerate(sources):
        digests = [x[2] for x in leaves[s]]
        root, upper = climb(subroots, place)
        for i, (has, doc, digest) in enumerate(leaves[s]):
            proof = [*climb(digests, i)[1], *upper]
            out.append((doc if has else None, digest, subroots[place], root, h(*[x for level in proof for x in level])))
    return sorted(out, key=str)


def check(docs, height=merkle.HEIGHT):
    got = merkle.verify(docs, F.lit(False), F.col("text"), height)
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    found = got.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("siblings")), "folded_root", "verified").collect()
    assert sorted([tuple(r)[:5] for r in found], key=str) == brute(rows)
    assert all(r.verified and r.folded_root == r.root for r in found)


def test_odd_rows(odd, none):
    check(odd)
    check(odd.where("doc_id = 8"))
    assert merkle.verify(none, F.lit(False), F.col("text")).count() == 0


def test_segments_of_several_rounds(make_docs):
    rows = [(i, f"text {i}", "en", "hot" if i < 200 else f"s{i % 30}") for i in range(300)]
    rows += [(5, "same", "en", "hot")] * 40  # equal leaves
    check(make_docs(rows), 2)


def test_clashing_columns(odd):
    docs = odd.selectExpr("*", "1 AS tree", "2 AS rank", "3 AS digest", "4 AS place", "'x' AS _at", "5 AS request")
    assert merkle.verify(docs, F.lit(False), F.col("text")).count() == odd.count()


def test_a_changed_text_is_found(make_docs):
    docs = make_docs([(i, f"a\nb{i}" if i % 3 else f"ab{i}", "en", "s") for i in range(100)])
    got = merkle.verify(docs, F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).collect()
    assert {r.doc_id for r in got if not r.verified} == {i for i in range(100) if i % 2 == 0 and i % 3}


def test_only_some_requests(spark, make_docs):
    docs = make_docs([(i, f"t{i}", "en", f"s{i % 4}") for i in range(500)])
    made = merkle.manifest(docs.select("doc_id", "source", merkle.leaf_digest([F.col("text")]).alias("digest")), "source", "doc_id", "digest")
    asked = made.leaves.where("doc_id % 97 = 0").select("tree", "n", "rank", F.struct("doc_id").alias("request"))
    got = merkle.prove(made, asked)
    ok = got.select(F.col("request")["doc_id"], (merkle.fold(F.col("digest"), F.col("positions"), F.col("siblings")) == made.root).alias("ok"))
    assert sorted(map(tuple, ok.collect())) == [(i, True) for i in range(0, 500, 97)]


def test_query_and_twin(spark, sf):
    got = queries.QUERIES["op12_merkle_manifest"](spark, sf).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(queries.TWINS["op12_merkle_manifest"]).df()
    order = sorted(got.columns)
    assert sorted(map(tuple, got[order].values)) == sorted(map(tuple, want[order].values))
    assert all(got[got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 2 == 1)].verified) and not all(got.verified)
