"""Edge cases of requests, sentences, hints and marches."""

import math

import pytest
import regex
from pyspark.sql import functions as F

from umbra.functions import requests, text
from umbra.operators import marches
from umbra.queries import QUERIES

RAY = "rid long, x double, y double, azimuth double, altitude double, leaf_off boolean, level double"


def _plain_sentences(source):
    ends = [0]
    for m in regex.finditer(r"([.!?…]+[\"”’)\]]*)(\s+)|\n+", source):
        word = regex.search(r"[\p{L}\d]+$", source[: m.start()])
        word = word.group() if word else ""
        number = word.isascii() and word.isdigit()
        held = m.group(1) == "." and (word.lower() in text.ABBREVIATIONS or (len(word) == 1 and not number) or (number and not regex.match(r"\p{Lu}", source[m.end() :])))
        if not held:
            ends.append(m.end())
    found = [" ".join(regex.sub(r"[ \t\n\x0b\f\r]+", " ", source[a:b]).split(" ")).strip(" ") for a, b in zip(ends, [*ends[1:], len(source)])]
    return [s for s in found if regex.search(r"[\p{L}\d]", s)]


CASES = ["", "Idź ul. Długą. Potem w lewo!  Koniec", "J. Kowalski mieszka przy ul.\nKrótkiej 5. Tak.", "O 15:00. Idź. Dnia 15. lipca", 'Cicho… "Tak?" Nie.) Dalej\n\n- punkt\n***\nkoniec.', "...", "Nr 7. 8. Dziewięć. x. y"]


def test_sentences(spark):
    rows = spark.createDataFrame([*enumerate(CASES), (99, None)], "i int, t string")
    got = {r["i"]: r["s"] for r in rows.select("i", text.sentences(F.col("t")).alias("s")).collect()}
    assert got == {**{i: _plain_sentences(c) for i, c in enumerate(CASES)}, 99: None}
    assert got[1] == ["Idź ul. Długą.", "Potem w lewo!", "Koniec"]


def test_held_stops_are_looked_for_at_stops_only(spark):
    """A pattern that begins with a look-behind is tried at every character of a text."""
    assert text._HELD.startswith(r"\.")
    cases = ["ul. A", "xul. A", "Ul.\tA. B", "123456789012345678. a b. C", "1234567890123456789. a", "Dnia 15.\n lipca. 7.x", "é. Łódź. ł. Ó", "a.. b", "św.) Tak", "tj.  \n\nNr"]
    rows = spark.createDataFrame([*enumerate(cases)], "i int, t string")
    got = {r["i"]: r["s"] for r in rows.select("i", text.sentences(F.col("t")).alias("s")).collect()}
    old = r"(?:(?<=(?:^|[^\p{L}\d])(?:(?iu:" + "|".join(text.ABBREVIATIONS) + r")|\p{L}))\.|(?<=(?:^|[^\p{L}\d])\d{1,18})\.(?=\s++(?!\p{Lu})))\s+"
    held = rows.select("i", (F.regexp_replace("t", old, "!") == F.regexp_replace("t", text._HELD, "!")).alias("same")).collect()
    assert all(r["same"] for r in held) and got[0] == ["ul. A"] and got[1] == ["xul.", "A"]


def test_sentences_of_documents(spark):
    sf = "/root/testdata/sf0.001"
    want = {(r["doc_id"], i, s) for r in spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL").collect() for i, s in enumerate(_plain_sentences(r["text"]))}
    assert {(r["doc_id"], r["place"], r["sentence"]) for r in QUERIES["str_17_sentences"](spark, sf).collect()} == want


@pytest.mark.parametrize(("raw", "kept"), [("2026-07-15T13:00:00+02:00", True), (" 2026-07-15t13:00z ", True), ("2026-02-30T13:00Z", False), ("2026-07-15T13:00", False), ("2026-07-15T25:00Z", False), ("2026-07-15T24:00Z", True), ("", False), (None, False)])
def test_moment(spark, raw, kept):
    assert (spark.createDataFrame([(raw,)], "r string").select(requests.moment(F.col("r")).alias("m")).first()["m"] is not None) is kept


@pytest.mark.parametrize(("raw", "box"), [("1,2,3,4", [1, 2, 3, 4]), (" 1 , ,3e0, .5", [1, 0, 3, 0.5]), ("3,2,1,4", None), ("1,2,3,91", None), ("1,2,3", None), ("1,2,3,4,5", None), ("1d,2,3,4", None), ("1,2,NaN,4", None), ("", None), (None, None)])
def test_bounds(spark, raw, box):
    assert spark.createDataFrame([(raw,)], "r string").select(requests.bounds(F.col("r")).alias("b")).first()["b"] == box


def test_marches_over_nothing(spark):
    rays = spark.createDataFrame([(1, 1.0, 1.0, 0.0, 0.3, False, 1.5), (2, 1.0, 1.0, 0.0, -0.3, False, 1.5)], RAY)
    none = spark.createDataFrame([], "row long, col long, value double, base double")
    assert marches.behind_terrain(rays, none, 5.0).count() == 0
    assert {r["rid"]: r["share"] for r in marches.through_vegetation(rays, none, 5.0).collect()} == {1: 1.0}


def test_ridge_and_hedge(spark):
    """A ridge of 20 m in the north hides a low sun; a hedge dims it by the height that is shared with its crowns."""
    ground = spark.createDataFrame([(r, c, 20.0 if r == 10 else 0.0, 0.0) for r in range(20) for c in range(5)], "row long, col long, value double, base double")
    rays = spark.createDataFrame([(1, 12.0, 10.0, 0.0, math.atan(0.2), False, 1.5), (2, 12.0, 10.0, 0.0, math.atan(0.8), False, 1.5), (3, 12.0, 10.0, math.pi, math.atan(0.2), False, 1.5)], RAY)
    assert [r["rid"] for r in marches.behind_terrain(rays, ground, 5.0).collect()] == [1]
    got = {r["rid"]: r["share"] for r in marches.through_vegetation(rays, ground, 5.0).collect()}
    assert got[1] == pytest.approx(max(0.05, math.exp(-math.log(4) / 6 / math.sin(math.atan(0.2)) * 1.0))) and got[2] == 1.0 and got[3] == 1.0


def test_hints_in_order(spark):
    lanes = [(1, 0, 0.0, 50.0, "left", 0.1), (1, 1, 50.0, 70.0, None, 0.9), (1, 2, 70.0, 130.0, "", 0.8), (1, 3, 130.0, 200.0, "right", 0.2), (2, 0, 0.0, 9.0, None, 0.5), (2, 1, 9.0, 99.0, None, 0.0)]
    segments = spark.createDataFrame(lanes, "r long, seg int, start_m double, end_m double, side string, sun double")
    fixes = spark.createDataFrame([(1, 1, 10.0, True), (2, 1, 60.0, False), (3, 1, 125.0, False), (4, 1, 999.0, True), (5, 2, 0.0, True), (6, 7, 0.0, True)], "fid long, r long, along_m double, wants_sun boolean")
    got = {r["fid"]: (r["what"], r["seg"], r["distance_m"], r["run_m"], r["good"]) for r in marches.hints(fixes, segments, "r").collect()}
    assert got == {1: ("side", 3, 120.0, None, True), 2: ("shade", 3, 70.0, 70.0, True)}
