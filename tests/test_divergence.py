import re
from collections import defaultdict

from tesserae.plans.ingestion import numeric_divergence


def documents(spark, path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_all_divergent_pairs(spark, tmp_path):
    texts = ["10 units 12 units 15 units", " ".join(f"{v} units" for v in range(100, 151)), "10 units 10 units 40 units", "7 days 8 hours", None]
    got = {(r["doc_id"], r["unit"]): (r["n"], r["ratio"]) for r in numeric_divergence(spark, documents(spark, tmp_path, texts)).collect()}
    want = defaultdict(list)
    for i, t in enumerate(texts):
        found = {(float(v), u) for v, u in re.findall(r"(\d+) (units|days|hours)", t or "")}
        for v, u in found:
            want[i, u] += [v / w for w, x in found if x == u and 1.02 < v / w < 2]
    assert got == {k: (len(r), round(max(r), 6)) for k, r in want.items() if r}
    assert got[0, "units"] == (3, 1.5) and got[1, "units"][1] == 1.5
