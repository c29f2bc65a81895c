"""Queries over clouds that are written for the test, against their SQL."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from pointloom.operators import reconstruction
from pointloom.plans import cloud, oracles


def by_sql(folder, name, xyz):
    """Writes points (x, y, z) as lines, in their order, and gives the rows of the SQL."""
    n = range(len(xyz))
    x, y, z = zip(*xyz, strict=True)
    columns = {"l_orderkey": pa.array(n, pa.int64()), "l_linenumber": pa.array([1 for _ in n], pa.int32()), "l_partkey": pa.array(n, pa.int64()), "l_suppkey": pa.array(n, pa.int64())}
    pq.write_table(pa.table(columns | {"l_quantity": [float(v) for v in x], "l_extendedprice": [v * 100.0 for v in y], "l_discount": [v / 1000 for v in z]}), folder / "lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{folder}/lineitem.parquet'")
    return sorted(con.execute(oracles.SQL[name]).fetchall())


def test_spheres_through_a_corner_of_the_box_are_as_in_the_sql(spark, tmp_path):
    found = [
        ((50, 600, 0), (1, 752, 40), (12, 821, 80), (31, 797, 90)), ((27, 1031, 30), (45, 919, 80), (50, 600, 0), (45, 736, 70)), ((32, 717, 60), (50, 600, 0), (3, 922, 40), (3, 749, 20)),
        ((36, 910, 40), (48, 640, 20), (3, 821, 20), (50, 600, 0)), ((50, 600, 0), (41, 852, 100), (34, 776, 90), (20, 1045, 10)),
    ]
    want = by_sql(tmp_path, "circumsphere_filter", [p for c in found for p in c])
    got = cloud.circumsphere_filter(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == want and len(got) == len(found)


def test_points_at_one_place_are_located_once_and_counted_each(spark, tmp_path, monkeypatch):
    few = [(8, 64, 0), (50, 130, 10), (17, 63, 100), (16, 72, 40), (9, 71, 30)]
    want = by_sql(tmp_path, "located_points", few * 40)
    rows, located = [], reconstruction.located

    def spy(cells, places, edge):
        rows.append(places.count())
        return located(cells, places, edge)

    monkeypatch.setattr(reconstruction, "located", spy)
    got = cloud.located_points(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == want and sum(r.n for r in got) == 200
    assert rows == [len(few)]
