import zlib

import numpy as np
from helpers import edge_docs, empty_docs, rows_of
from pyspark.sql import functions as F

from gridspark.llm import catalog
from gridspark.llm import token_files as T
from gridspark.llm.common import shared_path


def expected(docs, path):
    from tokenizers import Tokenizer
    library, start = Tokenizer.from_file(path), 0
    for doc, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, catalog.END_ID]
        yield doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_query(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in rows_of(spark, sf, "documents"))
    got = catalog.op2_token_files(spark, sf).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == list(expected(docs, catalog.tokenizer_path()))


def test_edges(spark):
    hard = ["it's (good). A.B,c! x<|endoftext|>y <|startoftext|> <|ENDOFTEXT|> don't'", "İi Ǆ ﬁ é é b c\x1cd .,!? ...", "’s 'S 'll x'll,", "À. ̀x 12,5"]
    docs = edge_docs(spark).unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(hard)], "doc_id bigint, text string"), allowMissingColumns=True)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path, kind = shared_path(spark, "tokens"), catalog.tokenizer_path(name)
        T.write_token_files(docs, path, kind, catalog.END_ID)
        back = T.read_token_files(spark, path)
        got = {}
        for r in T.token_digests(back).collect():
            got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
        want = {}
        for doc, _, n, crc in expected([(r.doc_id, r.text) for r in docs.collect()], kind):
            want.setdefault(doc, []).append((n, crc))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
        rows = T.token_digests(back).orderBy("start").collect()
        assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
        ids = [r.doc_id if r.doc_id is not None else -10**9 for r in rows]
        assert ids == sorted(ids)
        assert back.where("doc_id = 6").count() == 2
        assert "doc_id" in back.where(F.col("doc_id") == 6)._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
    path = shared_path(spark, "tokens")
    T.write_token_files(empty_docs(spark), path, kind, catalog.END_ID)
    assert T.token_digests(T.read_token_files(spark, path)).count() == 0
