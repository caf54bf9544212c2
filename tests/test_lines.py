"""The strict line reader: fixed cases, the columnar path against the strict one, and the operator."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from tallyweir.sources import lines as L

T0 = 1_709_318_208_692_812
GOOD = {"name": "Nad", "country": "Ruz", "iata": "XQ", "height": "12.5", "tz": "A/B"}


def obs(mark="|", time=T0, **other):
    return str(time) + "".join(f"{mark}{k}={v}" for k, v in (GOOD | other).items())


@pytest.mark.parametrize(
    ("line", "layout", "reason"),
    [
        (None, "obs", "time"),
        ("", "obs", "time"),
        ("abc", "csv", "time"),
        ("-1709318208692812,a,b,c,1,e", "csv", "time"),
        ("1709318208.692812,a,b,c,1,e", "csv", "time"),
        ("99999999999999999999999999,a,b,c,1,e", "csv", "time"),
        ("946684799999999,a,b,c,1,e", "csv", "time"),
        ("946684800000000,a,b,c,1,e", "csv", None),
        ("4102444800000000,a,b,c,1,e", "csv", "time"),
        (f"{T0} ,a,b,c,1,e", "csv", "time"),
        (f"{T0}", "csv", "columns"),
        (f"{T0},", "csv", "columns"),
        (f"{T0},a,b,c,1,e", "csv", None),
        (f"{T0},a,b,c,1,e\r", "csv", None),
        (f"{T0},a,b,c,1\r", "csv", "columns"),
        (f"{T0},a,b,c,1\r,e", "csv", "height"),
        (f"{T0},a,b,c,1,e,", "csv", "columns"),
        (f'{T0},"a, ""b""\nc",b,c,1,e', "csv", None),
        (f'{T0},"a"x,b,c,1,e', "csv", "quoting"),
        (f'{T0},"a,b,c,1,e', "csv", "quoting"),
        (f'{T0},a"b,b,c,1,e', "csv", "quoting"),
        (f'{T0},a,b,c,"1",e', "csv", None),
        (f'{T0},a,b,c,"",e', "csv", None),
        (f"{T0},a,b,c,1e999,e", "csv", "height"),
        (f"{T0},a,b,c, 1,e", "csv", "height"),
        (f"{T0},a,b,c,+1.50E2,e", "csv", None),
        (f"{T0},a,b,c,1.,e", "csv", "height"),
        (f"{T0},a,b,c,NaN,e", "csv", "height"),
        (f"{T0},a,b,c,١,e", "csv", "height"),
        (obs(), "obs", None),
        (obs("\t"), "obs", None),
        (obs("é"), "obs", None),
        (obs("x") + "x", "obs", "columns"),
        (obs("="), "obs", "columns"),
        (obs('"'), "obs", "quoting"),
        (f"{T0}", "obs", "columns"),
        (obs(height=""), "obs", None),
        (obs().replace("height=12.5", "height"), "obs", None),
        (obs() + "|name=again", "obs", "columns"),
        (obs() + "|", "obs", "columns"),
        (obs(name='"a|b"'), "obs", None),
        (obs(name="a=b"), "obs", None),
        (obs(name='x"y'), "obs", "quoting"),
        (obs() + '|"na"me=1', "obs", "quoting"),
        (obs(height="1 m", name='"'), "obs", "quoting"),
        (obs(), None, None),
        (obs(), "other", None),
    ],
)
def test_reasons(line, layout, reason):
    assert L.strict(line, layout)[0] == reason


def test_values():
    assert L.strict(f'{T0},"a ""b""",,,"-2",z', "csv") == (None, (T0, 'a "b"', "", "", -2.0, "z"))
    assert L.strict(obs(height="", name='"a|b"'), "obs")[1] == (T0, "a|b", "Ruz", "XQ", None, "A/B")


def _random_line(rng):
    csv = rng.random() < 0.4
    mark = "," if csv else rng.choice("|;\t,x\\^-].*")
    value = lambda: rng.choice(["", "a", "a b", "é", '"q"', '"a""b"', '"x\ny"', f'"{mark}"', "x\ny", "a=b", "1"])
    fields = dict.fromkeys(L.FIELDS, "")
    fields = {f: value() for f in fields} | {"height": rng.choice(["", "1", "-2.5", "+3", "007", "1e3", '"4"'])}
    names = list(fields)
    if not csv:
        rng.shuffle(names)
    parts = [fields[n] if csv else (n if not fields[n] and rng.random() < 0.3 else f"{n}={fields[n]}") for n in names]
    line = mark.join([str(T0 + rng.randrange(10**9)), *parts])
    if rng.random() < 0.3:  # a random wound
        at = rng.randrange(len(line) + 1)
        line = line[:at] + rng.choice(['"', mark, "=", "9" * 20, "\r", "\n", "é", " ", "\0"]) + line[at + rng.randrange(2) :]
    return line + rng.choice(["", "", "\r"]), "csv" if csv else "obs"


@pytest.mark.parametrize("seed", range(6))
def test_columnar_path_agrees_with_strict(seed, monkeypatch):
    monkeypatch.setattr(L, "LEAF", [1, 2, 32][seed % 3])
    rng = random.Random(seed)
    made = [_random_line(rng) for _ in range(1500)]
    lines, layouts = [m[0] for m in made], [m[1] for m in made]
    table, reasons = L.parse_batch(pa.array(lines), pa.array(layouts))
    for row, why, line, layout in zip(table.to_pylist(), reasons.to_pylist(), lines, layouts):
        reason, values = L.strict(line, layout)
        assert why == reason, line
        assert tuple(row.values()) == (values or (None,) * 6), line


def test_bad_lines_are_isolated_by_failing_blocks(monkeypatch):
    """Blocks that fail part until the bad lines are alone: no good line is diagnosed, and each bad line with a delimiter
    was in a block that failed."""
    rng = random.Random(8)
    made = [_random_line(rng) for _ in range(6000)]
    bad = {i for i, (line, layout) in enumerate(made) if L.strict(line, layout)[0]}
    strict, columnar, diagnosed, blocks, failed = L.strict, {n: getattr(L, n) for n in ("_plain", "_quoted")}, [], [], []
    monkeypatch.setattr(L, "LEAF", 0)
    monkeypatch.setattr(L, "strict", lambda line, layout: diagnosed.append(line) or strict(line, layout))

    def watched(name):
        def run(lines, csv, mark):
            blocks.append(len(lines))
            try:
                return columnar[name](lines, csv, mark)
            except Exception:
                failed.extend(lines.to_pylist())
                raise

        return run

    for name in columnar:
        monkeypatch.setattr(L, name, watched(name))
    _, reasons = L.parse_batch(pa.array([m[0] for m in made]), pa.array([m[1] for m in made]))
    assert {i for i, r in enumerate(reasons.to_pylist()) if r} == bad and len(bad) > 300
    delimited = [made[i][0] for i in bad if re.match(r"[0-9]+[\t -/:-~]", made[i][0]) and made[i][0].removesuffix("\r") and re.match(r"[0-9]+(.)", made[i][0])[1] not in '"=']
    in_failed = sum(line.removesuffix("\r") in set(failed) for line in delimited)
    assert in_failed >= 0.95 * len(delimited)
    assert len(diagnosed) <= 1.02 * len(bad) and len(blocks) < 120


def test_byte_order_mark_and_blanks_are_not_digits():
    lines = ["﻿" + f"{T0},a,b,c,1,e"] + [f"{T0},a,b,c,1,e"] * 40 + [f" {T0},a,b,c,1,e"]
    _, reasons = L.parse_batch(pa.array(lines), pa.array(["csv"] * 42))
    assert [r for r in reasons.to_pylist() if r] == ["time", "time"]


def test_operator_keeps_columns_and_names(spark):
    schema = T.StructType([T.StructField("line", T.StringType()), T.StructField("layout", T.StringType()), T.StructField("name", T.LongType()), T.StructField("line_id", T.LongType())])
    df = spark.createDataFrame([(obs(), "obs", 7, 1), (None, None, None, 2), (obs(), "obs", 7, 1), ("1", "csv", 3, None)], schema)
    parsed = L.parse_lines(df, ["line_id", "name"])
    assert parsed.columns == ["line_id", "name_in", "reason", "data_time", *L.FIELDS]
    assert [r["name_in"] for r in L.loaded(parsed).collect()] == [7, 7]
    assert sorted(r["reason"] for r in L.rejects(parsed).collect()) == ["time", "time"]
    assert L.loaded(parsed).first()["data_time"].microsecond == T0 % 1_000_000
    assert L.parse_lines(df.limit(0), ["line_id"]).count() == 0
