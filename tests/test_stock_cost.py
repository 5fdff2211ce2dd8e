import random
from decimal import Decimal as D

import pytest

from pyspark.sql import functions as F

from conftest import values
from stonewatch.operators import cost, stock

LOT = "id bigint, material_id bigint, purchased date, unit_price decimal(10,2), available int"
REQUEST = "job_id bigint, material_id bigint, quantity int, seq bigint"
LOTS = [
    (1, 1, "2023-01-01", 5, 500), (2, 2, "2023-01-01", 3, 50), (3, 3, "2023-01-01", 25, 30),
    (4, 4, "2023-01-01", 60, 10), (5, 1, "2023-01-05", 5, 200), (6, 2, "2023-01-05", 4, 80),
]
USES = [(1, 1, 600, 1), (1, 2, 20, 2), (1, 3, 15, 3), (1, 4, 3, 4)]


def test_oldest_lots_first(make):
    got = stock.allocate(make(REQUEST, USES), make(LOT, LOTS))
    assert values(got, "lot_id", "quantity") == [(1, 500), (2, 20), (3, 15), (4, 3), (5, 100)]
    left = stock.remaining_stock(make(LOT, LOTS), got)
    assert values(left, "id", "available") == [(1, 0), (2, 30), (3, 15), (4, 7), (5, 100), (6, 80)]


def test_requests_share_lots_in_order(make):
    requests = [(1, 1, 450, 1), (2, 1, 150, 2), (3, 1, 0, 3)]
    got = stock.allocate(make(REQUEST, requests), make(LOT, LOTS))
    assert values(got, "job_id", "lot_id", "quantity") == [(1, 1, 450), (2, 1, 50), (2, 5, 100)]


def test_same_day_lots_go_by_id_and_excess_stays_unserved(make):
    lots = [(9, 1, "2023-01-01", 1, 5), (3, 1, "2023-01-01", 1, 5), (4, 1, "2022-12-31", 1, 0)]
    got = stock.allocate(make(REQUEST, [(1, 1, 99, 1)]), make(LOT, lots))
    assert values(got, "lot_id", "quantity") == [(3, 5), (9, 5)]


@pytest.mark.parametrize("seed", [5, 6])
def test_served_is_the_smaller_of_demand_and_stock(make, seed):
    rng = random.Random(seed)
    lots = [(i, rng.randint(1, 3), f"2023-01-{rng.randint(1, 28):02d}", 1, rng.randint(0, 40)) for i in range(60)]
    requests = [(i, rng.randint(1, 4), rng.randint(0, 60), i) for i in range(40)]
    got = stock.allocate(make(REQUEST, requests), make(LOT, lots)).collect()
    for m in range(1, 5):
        have = sum(r[4] for r in lots if r[1] == m)
        want = sum(r[2] for r in requests if r[1] == m)
        assert sum(r.quantity for r in got if r.material_id == m) == min(have, want)
    queue = {m: [[r[0], r[4]] for r in sorted(lots, key=lambda r: (r[2], r[0])) if r[1] == m] for m in range(1, 5)}
    by_hand = []
    for job, m, need, _ in requests:
        for lot in queue[m]:
            take = min(need, lot[1])
            if take:
                by_hand.append((job, lot[0], take))
                lot[1] -= take
                need -= take
    assert sorted((r.job_id, r.lot_id, r.quantity) for r in got) == sorted(by_hand)


def test_guards(make):
    requests = [
        (1, 1, 10, 1),  # used before
        (2, 1, -1, 2),
        (2, 9, 1, 3),  # no lots
        (2, 1, 701, 4),
        (3, 1, 700, 5),
        (4, 1, 1, 6),  # nothing left
        (4, 1, 0, 7),
        (5, 2, 131, 8),
        (5, 2, 130, 9),  # the larger one was refused, so not a repetition
        (5, 2, 0, 10),
    ]
    uses = make("job_id bigint, lot_id bigint, quantity int", [(1, 5, 3)])
    got = dict(values(stock.check_requests(make(REQUEST, requests), make(LOT, LOTS), uses), "seq", "reason"))
    assert got == {
        1: "material already used by the job",
        2: "negative quantity",
        3: "no stock of the material",
        4: "insufficient stock",
        5: None,
        6: "insufficient stock",
        7: None,
        8: "insufficient stock",
        9: None,
        10: "material already used by the job",
    }


def project_tables(make):
    uses = make("job_id bigint, lot_id bigint, quantity int", [(1, 1, 500), (1, 5, 100), (1, 2, 20), (1, 3, 15), (1, 4, 3)])
    jobs = make("id bigint, stage_id bigint, done boolean", [(1, 1, True)])
    stages = make("id bigint, project_id bigint, ended date", [(1, 1, "2020-12-23"), (2, 2, "2020-11-30")])
    shifts = make(
        "stage_id bigint, worker_id string, start timestamp_ntz, end timestamp_ntz",
        [(1, "D", "2020-12-02 10:00:00", "2020-12-02 18:00:00"), (1, "A", "2020-12-02 13:00:00", "2020-12-02 15:00:00"),
         (1, "B", "2020-12-02 11:00:00", "2020-12-02 17:00:00")],
    )
    people = make("id string, seniority int", [("A", 4), ("B", 5), ("D", 9), ("X", None)])
    management = make("project_id bigint, fee decimal(10,2)", [(1, 324000), (1, 20000)])
    projects = make("id bigint, building_id bigint, cost decimal(10,2)", [(1, 1, None), (2, 1, None)])
    return uses, jobs, stages, shifts, people, management, projects


def test_project_cost(make):
    uses, jobs, stages, shifts, people, management, projects = project_tables(make)
    materials = cost.material_cost(uses, make(LOT, LOTS), jobs)
    assert values(materials, "stage_id", "material_cost") == [(1, D("3615.00"))]
    labour = cost.labour_cost(shifts, people, "2023-02-01")
    # 8 h at 17, 2 h at 12, 6 h at 13
    assert values(labour, "labour_cost", "reason") == [(D("238.00"), None)]
    total = cost.project_cost(projects, management, stages, materials, labour)
    assert values(total, "project_id", "cost") == [(1, D("347853.00")), (2, D("0.00"))]
    strict = cost.project_cost(projects, management, stages, materials, labour, strict_nulls=True)
    assert dict(values(strict, "project_id", "cost"))[2] is None
    done = cost.finish_projects(projects, total.filter("project_id = 1"))
    assert values(done, "id", "cost") == [(1, D("347853.00")), (2, None)]


def test_labour_without_known_pay_has_a_reason(make):
    _, _, _, shifts, people, _, _ = project_tables(make)
    late = cost.labour_cost(shifts, people, "2025-12-02")
    assert values(late, "labour_cost", "reason") == [(None, "date out of range")]
    odd = make(
        "stage_id bigint, worker_id string, start timestamp_ntz, end timestamp_ntz",
        [(7, "X", "2020-12-02 10:00:00", "2020-12-02 18:00:00")],
    )
    assert cost.labour_cost(odd, people, "2023-02-01").first().reason == "unknown seniority"


def test_unknown_pay_makes_the_project_cost_unknown(make):
    uses, jobs, stages, shifts, people, management, projects = project_tables(make)
    materials = cost.material_cost(uses, make(LOT, LOTS), jobs)
    unpaid = cost.labour_cost(shifts, people.filter("false"), "2023-02-01")
    for strict in (False, True):
        total = cost.project_cost(projects, management, stages, materials, unpaid, strict_nulls=strict)
        (one,) = total.filter("project_id = 1").collect()
        assert (one.cost, one.reason) == (None, "unknown seniority")
    before = projects.withColumn("cost", F.lit(5).cast("decimal(10,2)"))
    done = cost.finish_projects(before, cost.project_cost(projects, management, stages, materials, unpaid))
    assert values(done, "id", "cost") == [(1, D("5.00")), (2, D("0.00"))]


def test_material_report_is_for_stages_ended_in_the_month(make):
    uses, jobs, stages, _, _, _, _ = project_tables(make)
    materials = make("id bigint, name string", [(1, "Mattone"), (2, "Intonaco"), (3, "Lastra"), (4, "Schiuma")])
    got = cost.material_report(uses, jobs, stages, make(LOT, LOTS), materials, 2020, 12)
    assert values(got, "material_id", "quantity") == [(1, 600), (2, 20), (3, 15), (4, 3)]
    assert cost.material_report(uses, jobs, stages, make(LOT, LOTS), materials, 2020, 11).count() == 0
