"""T1 with exact de-duplication: late and repeated lines, retried batches, ranges of ids."""

import random

import pytest

from carrierbook.streaming.exact_stock import BITS, BLOCKS_PER_RANGE, ExactStock

SCHEMA = "id long, location_id int, department_id int, type string, quantity int, product_type string"


def _line(i):
    return (i, i % 3 if i % 7 else None, i % 2, "IN" if i % 4 else "OUT", i % 11, None if i % 5 == 0 else "h1")


def _want(ids):
    out = {}
    for i in ids:
        _, loc, dep, kind, n, product = _line(i)
        ins, outs = out.get((loc, dep, product or "euro"), (0, 0))
        out[loc, dep, product or "euro"] = (ins + n, outs) if kind == "IN" else (ins, outs + n)
    return {k: (*v, v[0] - v[1]) for k, v in out.items()}


def _have(stock):
    return {(r["location_id"], r["department_id"], r["product_type"]): (r["ins"], r["outs"], r["saldo"]) for r in stock.current().collect()}


def test_late_and_repeated_lines_count_once(spark, tmp_path):
    rnd = random.Random(2)
    far = BITS * BLOCKS_PER_RANGE
    pool = [0, -1, -BITS, -BITS - 5, BITS, BITS + 1, far, far + 1, far * 9 + 3, 2 ** 40] + list(range(1, 300)) + list(range(BITS - 20, BITS + 20))
    stock, seen = ExactStock(spark, str(tmp_path)), set()
    for batch in range(4):
        ids = [rnd.choice(pool) for _ in range(150)]
        stock(spark.createDataFrame([_line(i) for i in ids], SCHEMA), batch)
        seen |= set(ids)
        assert _have(stock) == _want(seen)


def test_a_killed_batch_counts_once(spark, tmp_path):
    first, second = [_line(i) for i in range(20)], [_line(i) for i in range(10, 40)]
    stock = ExactStock(spark, str(tmp_path))
    stock(spark.createDataFrame(first, SCHEMA), 0)
    for part in (stock.seen.store, stock.totals):  # killed before either of the two commits
        kept = part.commit
        part.commit = lambda *a: (_ for _ in ()).throw(RuntimeError("killed"))
        with pytest.raises(RuntimeError):
            stock(spark.createDataFrame(second, SCHEMA), 1)
        part.commit = kept
        assert _have(stock) == _want(range(20))
    again = ExactStock(spark, str(tmp_path))
    again(spark.createDataFrame(second, SCHEMA), 1)
    again(spark.createDataFrame(second, SCHEMA), 1)
    assert _have(again) == _want(range(40))


def test_only_the_ranges_of_a_batch_are_written(spark, tmp_path):
    stock = ExactStock(spark, str(tmp_path))
    far = BITS * BLOCKS_PER_RANGE
    stock(spark.createDataFrame([_line(5), _line(far + 5)], SCHEMA), 0)
    stock(spark.createDataFrame([_line(far + 6), (None, 1, 1, "IN", 4, "euro")], SCHEMA), 1)
    assert len(list((tmp_path / "seen" / "ids" / "v=0").glob("bucket=*"))) == 2
    assert len(list((tmp_path / "seen" / "ids" / "v=1").glob("bucket=*"))) == 1
    stock(spark.createDataFrame([], SCHEMA), 2)
    assert sum(v[0] + v[1] for v in _have(stock).values()) == sum(_line(i)[4] for i in (5, far + 5, far + 6)) + 4
