"""CSV records read in byte ranges, against Python's csv module."""

from __future__ import annotations

import csv
import random

import pytest

from millrate.sources import csv_records as cr
from millrate.sources.roll_csv import RollLoadError, read_roll


def random_csv(rnd, rows, width=4):
    """Fields with commas, quotes (also unquoted), line ends and long quoted stretches."""
    def one():
        kind = rnd.random()
        text = "".join(rnd.choice('ab ,"\n') for _ in range(rnd.randint(0, 9)))
        if kind < 0.4:
            return '"' + text.replace('"', '""') + '"'
        if kind < 0.45:
            return '"' + "line, of \"\"quotes\"\"\n" * rnd.randint(20, 60) + '"'
        if kind < 0.5:
            return '"closed" then'
        plain = text.replace(",", "").replace("\n", "")
        return plain.lstrip('"') if kind < 0.8 else "xyz"
    return "a,b,c,d\n" + "".join(",".join(one() for _ in range(width)) + "\n" for _ in range(rows))


def rows_of(text):
    got = [r for r in csv.reader(text.splitlines(keepends=True)) if r]
    return got[1:]


@pytest.mark.parametrize("seed", range(4))
def test_random_files_in_small_ranges(spark, tmp_path, seed):
    rnd = random.Random(seed)
    texts = {f"f{i}.csv": random_csv(rnd, rnd.randint(0, 200)) for i in range(3)}
    texts["g.csv"] = 'a,b,c,d\n"x\ny",1,2,3\n\n1,2,3,4\n5,6,"never closed\nuntil the end'
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        records, headers = cr.read_records(spark, str(tmp_path))
        if seed == 0:
            assert cr._lines(spark, str(tmp_path)).rdd.getNumPartitions() > 8
        got = {}
        for r in records.orderBy("file", "at").collect():
            got.setdefault(r["file"].rsplit("/", 1)[1], []).append([x or "" for x in r["fields"]])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert headers == [["a", "b", "c", "d"]]
    for name, text in texts.items():
        assert got.get(name, []) == rows_of(text), name


def test_states_and_fields():
    rnd = random.Random(8)
    for _ in range(3000):
        text = "".join(rnd.choice('a,"') for _ in range(rnd.randint(0, 12)))
        if cr.state_after(text, cr.RECORD) == cr.RECORD:
            assert [x or "" for x in cr.split_record(text)] == (next(csv.reader([text]), []) or [""])
        else:
            assert next(csv.reader([text + "\n", "z"]))[-1].endswith("\nz")
    assert cr.split_record('"",,x') == ["", None, "x"]


HEAD = ["parcel_id", "owner_name", "property_address", "bill_number", "assessment_value", "face_tax_amount",
        "discount_amount", "penalty_amount", "tax_type"]
ROW = dict(zip(HEAD, ["P-1", "Ann", "1 St", "B1", "1000", "200.00", "196.00", "220.00", "School"]))


def write(path, columns, rows):
    with open(path, "w", newline="") as out:
        w = csv.writer(out)
        w.writerow(columns)
        w.writerows([r.get(c, "") for c in columns] for r in rows)


def test_each_file_by_its_own_header(spark, tmp_path):
    write(tmp_path / "a.csv", HEAD, [ROW])
    other = ["owner_name", "penalty_amount", "parcel_id", "is_installment_plan", "mailing_address",
             *[c for c in reversed(HEAD) if c not in ("owner_name", "penalty_amount", "parcel_id")]]
    write(tmp_path / "b.csv", other, [ROW | {"parcel_id": "P-2", "owner_name": 'Bob, "Jr"\nEstate',
                                             "is_installment_plan": "1", "mailing_address": "Box 9"}])
    got = {r["parcel_id"]: r for r in read_roll(spark, str(tmp_path)).collect()}
    assert got["P-2"]["owner_name"] == 'Bob, "Jr"\nEstate'
    assert [str(got[p][c]) for p in ("P-1", "P-2") for c in ("discount_amount", "penalty_amount")] == [
        "196.00", "220.00"] * 2
    assert (got["P-1"]["mailing_address"], got["P-2"]["mailing_address"]) == ("1 St", "Box 9")
    assert (got["P-1"]["is_installment_plan"], got["P-2"]["is_installment_plan"]) == (False, True)


def test_a_file_without_a_required_column_fails(spark, tmp_path):
    write(tmp_path / "a.csv", HEAD, [ROW])
    write(tmp_path / "b.csv", HEAD[1:], [ROW])
    with pytest.raises(RollLoadError):
        read_roll(spark, str(tmp_path))
