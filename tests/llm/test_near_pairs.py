"""Near-duplicate pairs whose smaller text fits its sketch and whose larger one does not."""

from lakeproof.llm.near_duplicates import near_duplicates
from lakeproof.session import ship


def test_pairs_about_the_sketch_size(spark):
    ship(spark)
    sizes = [(n, m) for n in range(45, 49) for m in range(58, 65) if 4 * n >= 3 * m]
    texts = {}
    for i, (n, m) in enumerate(sizes * 6):
        words = [f"p{i}x{j}" for j in range(m + 4)]
        texts[2 * i], texts[2 * i + 1] = " ".join(words[: n + 4]), " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}
    assert got == {2 * i + k: (pair[k], 2 * i) for i, pair in enumerate(sizes * 6) for k in (0, 1)}
