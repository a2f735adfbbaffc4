import random

from adatlas.operators import detect as D
from adatlas.operators import manifest as M


def test_only_brands_that_share_a_root_leave_the_jvm(spark):
    names = [(1, n) for n in ("Roca", "Roca Bath", "rocas", "Simon", "Cos", "Cosentino", "Zeta", "Zeta")] + [(2, "Roca"), (2, "Simons")]
    rows = {(r.issue_id, r.brand): r.of_root for r in D.with_roots(spark.createDataFrame(names, "issue_id int, brand string")).collect()}
    assert {k for k, n in rows.items() if n == 1} == {(1, "Simon"), (2, "Roca"), (2, "Simons")}
    assert rows[1, "rocas"] == 3 and rows[1, "Cosentino"] == 2 and rows[1, "Zeta"] == 2


def test_claimed_numbers_equal_trying_one_by_one():
    rng = random.Random(1)
    for _ in range(200):
        rows = [{"status": rng.choice(["ok", "ok", "ok", "failed", "duplicate"]), "wanted": rng.randrange(1, 12), "sha256": str(k)} for k in range(rng.randrange(1, 40))]
        used: set[int] = set()
        for row, n, _ in M.claimed(iter(rows)):
            want = row["wanted"]
            if row["status"] == "ok":
                while want in used:
                    want += 1
                used.add(want)
            assert n == want
