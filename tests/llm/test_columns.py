"""Extra columns of any name change nothing and are carried through."""

import pytest

from gridcast.llm import line_dedup, mixing, secrets, simhash, substring_dedup

ODD = ["SIZE", "_gc_before", "_gc_id", "_gc_hash", "_gc_spans", "_gridcast_lost", "_gc_row", "_gc_text", "c0", "a.b", "kept", "N_WORDS",
       "N_Dropped", "r0"]


@pytest.mark.parametrize("call", [mixing.mix, line_dedup.drop_repeated_lines, substring_dedup.remove_repeats, secrets.scan,
                                  simhash.near_duplicates])
def test_odd_names(spark, call):
    rows = [(i, f"some words of document {i % 3}\na line that is long enough to repeat", "s", *[f"{c}{i}" for c in ODD]) for i in range(6)]
    plain = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, text string, source string")
    odd = spark.createDataFrame(rows, "doc_id bigint, text string, source string, " + ", ".join(f"`x{i}` string" for i in range(len(ODD))))
    odd = odd.toDF("doc_id", "text", "source", *ODD)
    want, got = call(plain), call(odd)
    told = {r["doc_id"]: r.asDict() for r in got.collect()}
    for r in want.collect():
        assert {k: told[r["doc_id"]][k] for k in r.asDict()} == r.asDict()
    new = {c.lower() for c in want.columns}
    for c in ODD:
        if c.lower() not in new:
            assert told[4][c] == f"{c}4"
        elif c not in want.columns:
            assert c not in got.columns
