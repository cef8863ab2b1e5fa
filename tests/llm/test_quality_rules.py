import os
import re
from collections import Counter

import pytest

from lorekeep.llm import quality_rules
from tests.llm.common import documents

CLEAN = " ".join(f"Word{a}{b} in {b}{a}text, x{a * 3}{b}." for a in "abcdef" for b in "ghijk")
JUNK = " ".join(f"junk{i}$$$ %%%more" for i in range(60))


def base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(tri)
    rep = {j for i, x in enumerate(tri) if c[x] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep)


def test_base_and_verdicts(spark):
    texts = [None, "", " \n\x0b ", "a", "a b", "a b c", "a b c a b c", "x x x x", "l\nl\n\nl \n \n", "#*$%&|<> é日", CLEAN, JUNK, "rep eat ed " * 3000, CLEAN + "\n" + CLEAN]
    docs = documents(spark, list(enumerate(texts)) + [(None, CLEAN), (10, CLEAN)], extra=True)
    labels = spark.createDataFrame([(10, 1, 0), (10, 0, 0), (11, 0, 0), (None, 1, 0), (12, None, None)], "doc_id long, quality int, toxic int")
    out = quality_rules.quality_rules(docs, labels)
    assert out.columns == [*docs.columns, "__rules"]
    rows = out.collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        x = r["__rules"]
        n = base(r["text"])
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == n
        assert x.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (x.kept and x.base_failed)
    kept = {r["doc_id"]: r["__rules"].kept for r in rows}
    assert kept[10] and kept[None] and not kept[11]


def test_no_trusted_rows_and_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality_rules.quality_rules(documents(spark, [(1, CLEAN), (2, JUNK)]), labels).collect()
    assert all(r["__rules"].llr == 0 and r["__rules"].kept for r in rows)
    assert quality_rules.quality_rules(documents(spark, []), labels).count() == 0


def test_main_path_is_native(spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    plan = quality_rules.quality_rules(documents(spark, [(1, CLEAN)]), labels)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert os.path.exists(quality_rules.__file__)


@pytest.mark.parametrize("text", ["", " a b ", "\n"])
def test_words_of(spark, text):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(text,)], "t string").select(quality_rules.words_of(F.col("t")).alias("w")).first().w
    assert got == text.split()
