import re
from collections import Counter

from tesserae.plans.strategies import term_statistics


def documents(spark, path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_terms_of_any_script(spark, tmp_path):
    texts = ["Größe und Maße über 5,5 cm", "élève naïve, ÉLÈVE!", "发票 比率。 发票 审计", "mañana (señor) plain/ascii", "größe", None, ""]
    want = Counter()
    for t in texts:
        parts = (re.sub(r"[?!\"']+$", "", p) for p in re.split(r"[ \t\n\x0b\f\r/._\-:;,(){}\[\]]+", (t or "").lower()))
        want.update({p for p in parts if len(p) > 1})
    got = {r["term"]: r["df"] for r in term_statistics(spark, documents(spark, tmp_path, texts)).collect()}
    assert got == want
    assert got["größe"] == 2 and got["发票"] == 1 and "gr" not in got
