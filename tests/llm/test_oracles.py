import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import cases  # noqa: E402

from orebed.llm.queries import ORACLES, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    """Driver tables, and awkward rows with ids of their own in tables of the same columns."""
    odd = tmp_path_factory.mktemp("odd")
    d = pd.read_parquet(f"{cases.SF}/documents.parquet")
    # DuckDB can't hold the windows of the very long texts; brute force covers these.
    rows = {i: t for i, t in cases.rows() if i is not None and len(t or "") < 50_000}
    own = pd.DataFrame({"doc_id": list(rows), "text": list(rows.values())}).astype({"doc_id": "int64"})
    own.assign(lang="en", source="s", n_chars=own["text"].str.len().fillna(0).astype("int64"))[d.columns].to_parquet(odd / "documents.parquet")
    pages = [(1152921504606846977, "u", "same"), (1152921504606846979, None, "same"), (1152921504606846978, "u", "other"), (3, "u", None), (4, "u", ""), (5, "http://e/ x", "é\r\n\r\n")]
    pd.DataFrame(pages, columns=["page_id", "url", "html"]).to_parquet(odd / "pages.parquet")
    own = pd.read_parquet(f"{cases.SF}/documents.parquet").sort_values("doc_id").head(8)["text"].tolist()
    items = [(1, own[1]), (2, None), (3, " .. "), (None, "x"), (4, "order number day"), (5, "a b"), (5, "SAME line"), (6, own[3])]
    pd.DataFrame(items, columns=["item_id", "text"]).astype({"item_id": "Int64"}).to_parquet(odd / "benchmark.parquet")
    return {"driver": cases.SF, "odd": str(odd)}



@pytest.mark.parametrize("which", ["driver", "odd"])
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, folders, name, which):
    folder = folders[which]
    db = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        db.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = db.sql(ORACLES[name])
    got = QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(want.columns)
    got = [tuple(None if x is None else str(x) for x in r) for r in got.select(*sorted(got.columns)).collect()]
    assert sorted(got, key=repr) == sorted((tuple(None if x is None else str(x) for x in r) for r in want.select(", ".join(sorted(want.columns))).fetchall()), key=repr)
