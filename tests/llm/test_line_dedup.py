import math
import random
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from nearwave.llm.line_dedup import line_report, without_site_boilerplate
from tests.llm.odd_texts import ODD_TEXTS

BLANKS = " \t\v\f\r"


def plain(rows, max_ratio=0.05, copies=True):
    pages, counts = Counter(), Counter()
    for site, text in [r[1:] for r in rows] if copies else {r[1:] for r in rows}:
        pages[site] += 1
        counts.update((site, line) for line in {x.strip(BLANKS) for x in (text or "").split("\n")} if line)
    bad = {(s, line) for (s, line), n in counts.items() if n - 1.645 * math.sqrt(n) > max_ratio * pages[s]}
    out = []
    for doc_id, site, text in rows:
        lines = text.split("\n") if text is not None else []
        kept = [x for x in lines if (site, x.strip(BLANKS)) not in bad]
        out.append((doc_id, site, None if text is None else "\n".join(kept), len(lines) - len(kept)))
    return out


def rows_for():
    rng = random.Random(9)
    rows = []
    for i in range(300):
        site = rng.choice(["a", "a", "b", "c", None])
        lines = [f"line {rng.randrange(2000)}" for _ in range(rng.randint(1, 8))]
        if rng.random() < 0.3:
            lines.insert(0, "  Home | About\t")
        if site == "b":
            lines += ["footer of b", "footer of b "]
        rows.append((i, site, "\n".join(lines)))
    return rows + [(300 + i, "odd", t) for i, t in enumerate(ODD_TEXTS)] + [(400 + i, "same", "only line") for i in range(12)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id BIGINT, source STRING, text STRING").repartition(4)


def test_against_brute_force(spark):
    rows = rows_for()
    got = {r.doc_id: r for r in line_report(frame(spark, rows)).collect()}
    for doc_id, site, text, dropped in plain(rows):
        assert (got[doc_id].source, got[doc_id].text, got[doc_id].n_dropped) == (site, text, dropped)
    assert len(got) == len(rows)
    assert got[400].text == "" and got[300].text is None and any(r.n_dropped for r in got.values())


def test_sites_of_every_size(spark):
    """A footer on all pages goes from three pages on, a line on few of many pages stays."""
    rows = []
    for n in (1, 2, 3, 9, 14, 15, 26, 27):
        for i in range(n):
            lines = [f"own line {n} {i}", "footer"]
            lines += ["on two"] * (i < 2) + ["on four"] * (i < 4) + ["on five"] * (i < 5)
            rows.append((len(rows), f"site of {n}", "\n".join(lines)))
    got = {r.doc_id: r for r in line_report(frame(spark, rows)).collect()}
    assert all((got[i].text, got[i].n_dropped) == (text, n) for i, _, text, n in plain(rows))
    left = {site: set(got[i].text.split("\n")[1:]) for i, site, _ in rows if rows[i - 1][1] != site}
    assert left["site of 1"] == left["site of 2"] == {"footer", "on two", "on four", "on five"}
    assert left["site of 3"] == {"on two"}  # the others are on all three pages
    assert left["site of 9"] == left["site of 14"] == {"on two"}
    assert left["site of 15"] == left["site of 26"] == {"on two", "on four"}
    assert left["site of 27"] == {"on two", "on four", "on five"}


def test_columns_stay(spark):
    docs = frame(spark, rows_for()).selectExpr("*", "length(text) AS n_chars", "1 AS site", "2 AS pages", "3 AS h1")
    cleaned = without_site_boilerplate(docs)
    assert cleaned.columns == docs.columns and cleaned.dtypes == docs.dtypes
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and (r.site, r.pages, r.h1) == (1, 2, 3) for r in cleaned.collect())
    assert without_site_boilerplate(docs.limit(0)).count() == 0


def test_pipeline_keeps_a_text_of_many_copies(spark):
    rng = random.Random(10)
    copy = "\n".join(f"copied line {i}" for i in range(5))
    rows = [(i, "a", copy) for i in range(50)]
    rows += [(50 + i, "a", "\n".join([f"line {rng.randrange(10**6)}" for _ in range(4)] + ["footer"])) for i in range(100)]
    docs = frame(spark, rows).selectExpr("*", "length(text) AS n_chars")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert len(got) == 150 and all(got[i] == copy for i in range(50))
    assert all(got[i] == text.removesuffix("\nfooter") for i, _, text in rows[50:])


def test_clashing_names(docs_of):
    docs = docs_of([f"Footer line\nown line {i}" for i in range(20)])
    want = sorted(r.text for r in without_site_boilerplate(docs).collect())
    assert want == sorted(f"own line {i}" for i in range(20))
    for name in ("_site", "_kept", "_n_dropped", "_boilerplate", "site", "keys", "pages"):
        rows = without_site_boilerplate(docs.withColumn(name, F.lit("mine"))).collect()
        assert sorted(r.text for r in rows) == want and all(r[name] == "mine" for r in rows)
