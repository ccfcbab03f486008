from itertools import product

from docproof.operators import verdicts as V


def step(cur, new):
    """The rule, restated for one proposal."""
    if cur is None or cur[0] == "PENDING":
        return new
    if cur[1] is not None or (cur[0] == "FAIL" and new[0] != "FAIL") or V.STANDING[new[0]] > V.STANDING[cur[0]]:
        return cur
    return new


def test_fold_of_all_short_sequences(spark):
    rows, want, key = [], {}, 0
    for n in (1, 2, 3):
        for seq in product(V.STANDING, repeat=n):
            for mark in (None, *range(n)):
                cur = None
                for k, v in enumerate(seq):
                    new = (v, "existence" if k == mark else None)
                    rows.append((key, k, 0, *new))
                    cur = step(cur, new)
                want[key] = cur
                key += 1
    df = spark.createDataFrame(rows, "id long, stage_ord int, seq int, verdict string, suppressed_by string")
    got = {r.id: (r.verdict, r.suppressed_by) for r in V.fold(df, ["id"]).collect()}
    assert got == want


def test_rollup_precedence(spark):
    rows = [
        (1, "existence", "PENDING", None), (2, "existence", "NOT_FOUND", None), (2, "quote", "FAIL", None), (3, "existence", "NOT_FOUND", None), (3, "quote", "NOT_CHECKABLE", None),
        (4, "existence", "PASS", None), (4, "quote", "AMBIGUOUS", None), (5, "existence", "PASS", "low"), (6, "existence", "PASS", None), (6, "quote", "N/A", None), (7, "existence", "N/A", None),
    ]
    df = spark.createDataFrame(rows, "id long, dimension string, verdict string, confidence string")
    got = {r.id: r.overall for r in V.rollup(df, ["id"]).collect()}
    assert got == {1: "PENDING", 2: "FLAGGED", 3: "UNVERIFIED", 4: "REVIEW", 5: "REVIEW", 6: "VERIFIED", 7: "REVIEW"}


def test_absence_is_never_a_failure(spark):
    """Whatever the lookup says, only what contradicts a citation fails it."""
    rows = [(s, n, a, r) for s, n, a, r in product((-1, 200, 300, 400, 404, 429, 500), (0, 1, 2), (True, False), ("PASS", "FAIL", "N/A"))]
    df = spark.createDataFrame(rows, "status int, n_matching int, name_asserted boolean, local_reporter string")
    failed = {(r.status, r.n_matching, r.name_asserted, r.local_reporter, r.dimension) for r in V.firewall(df).where("verdict = 'FAIL'").collect()}
    assert failed == {(300, 0, True, r, "case_name") for r in ("PASS", "FAIL", "N/A")} | {(400, n, a, r, "reporter_valid") for n in (0, 1, 2) for a in (True, False) for r in ("FAIL", "N/A")}


def test_reports_of_one_document(spark):
    import json

    from docproof.sources import sinks

    checks = spark.createDataFrame([(1, 1, "quote", "PASS"), (1, 1, "existence", "NOT_FOUND"), (1, 2, "quote", "FAIL"), (1, 2, "case_name", "AMBIGUOUS"), (1, 3, "quote", "PENDING"), (1, 4, "quote", "PASS")], "doc int, id int, dimension string, verdict string")
    entries = spark.createDataFrame([(1, 1, "UNVERIFIED"), (1, 2, "FLAGGED"), (1, 3, "PENDING"), (1, 4, "VERIFIED")], "doc int, id int, overall string")
    cells = {r.id: r.checks for r in sinks.checks_cell(checks, ["doc", "id"]).collect()}
    assert cells == {1: "existence: `NOT_FOUND`; quote: `PASS`", 2: "quote: `FAIL`; case_name: `AMBIGUOUS`", 3: "none decided", 4: "quote: `PASS`"}
    (report,) = sinks.report_lines(entries, checks, "doc", "id").collect()
    lines = report.report.split("\n")
    assert [x[4:].split("*")[0] for x in lines if x.startswith("- **")] == ["FLAGGED", "UNVERIFIED", "PENDING"] and "VERIFIED** 4" not in report.report
    assert lines[1].startswith("  - case_name: AMBIGUOUS.") and lines[2].startswith("  - quote: FAIL.")
    (row,) = sinks.ledger_json(entries, checks, "doc", "id").collect()
    said = json.loads(row.ledger)
    assert said["n"] == 4 and [e["overall"] for e in said["entries"]] == ["UNVERIFIED", "FLAGGED", "PENDING", "VERIFIED"] and len(said["entries"][1]["checks"]) == 2


def test_ledger_survives_a_restart(spark, tmp_path):
    from docproof.operators import ledger

    rows = spark.createDataFrame([(1, "a", "FLAGGED"), (2, "b", None)], "id long, name string, overall string")
    for _ in range(2):
        ledger.checkpoint(rows, str(tmp_path / "l"))
    again = ledger.reload(spark, str(tmp_path / "l"), "id long, name string, overall string, later string")
    assert sorted(map(tuple, again.collect())) == [(1, "a", "FLAGGED", None), (2, "b", None, None)]
    metrics = spark.createDataFrame([(0.8333, 0.24)], "p double, r double")
    assert [r.row for r in ledger.result_rows(metrics, {"p": "Precision", "r": "Recall"}).collect()] == ["| Precision | 83.3% |", "| Recall | 24.0% |"]
