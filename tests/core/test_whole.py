"""Queries on texts take each text whole and every document."""

import hashlib
from urllib.parse import quote

import pytest

from loomgraph.queries import graphs


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    same = "ab c" * 60
    rows = [(1, same + " <é> %+~*'()!"), (2, same + " 中 & \U0001f600"), (3, ""), (4, "short"), (5, "x" * 300_000 + "&\n"), (6, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path, dict(rows)


def test_uri_encode_whole(spark, folder):
    path, texts = folder
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    xml = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("'", "&apos;")
    got = {r["doc_id"]: r for r in graphs.QUERIES["uri_encode_whole"](spark, path).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        if t is None:
            assert got[i]["encoded"] is got[i]["same"] is got[i]["xml"] is None
        else:
            assert (got[i]["encoded"], got[i]["same"], got[i]["xml"]) == (md5(quote(t, safe="~*'()!")), True, md5(xml(t)))


def test_recover_prefix_suffix_all(spark, folder):
    path, texts = folder
    got = {r["doc_id"]: r["found"] for r in graphs.QUERIES["recover_prefix_suffix_all"](spark, path).collect()}
    assert got.keys() == texts.keys()
    assert got[1] and got[3] is got[4] is got[6] is None
