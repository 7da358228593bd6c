from pyspark.sql import functions as F

from veilspark.functions.checksums import KIND_VALID
from veilspark.operators.profile import checksum_profile

VALID = {
    "id_card": "110101199003078515 310101198512251235 440300197809150047 510102200012310095"
    " 11010119900307803X 11010119900307803x １10101199003078515",
    "bank_card": "6222021000112230 6217000000000014 4532110000000006",
    "luhn": "79927398713 6222021000112230 6217000000000014 4532110000000006",
    "uscc": "91110108MA01ABCD1E 91110108ma01abcd1e 9132010073958168XQ 12330108ABCDEFGHJ3",
}
INVALID = {
    "id_card": "110101199003078514 310101198512251230 440300197809150040 11010119900307851X"
    " 11010119900307851 1101011990030785155 123456789012345 11010119900307A515",
    "bank_card": "6222021000112231 6217000000000010 4532110000000000 0000000000"
    " 6222-0210-0011-2230 79927398713",
    "luhn": "79927398710 6222021000112231 abc",
    "uscc": "91110108MA01ABCD10 9132010073958168X0 12330108ABCDEFGHJ0 91110108MA01ABCD1I"
    " 91110108MA0OABCD1E 91110108MA01ABCD1 91110108MA01ABCD1EE",
}


def test_vectors(spark):
    rows = [
        (kind, value, expected)
        for table, expected in ((VALID, True), (INVALID, False))
        for kind, values in table.items()
        for value in values.split()
    ] + [(kind, value, False) for kind in VALID for value in ("", None)]
    df = spark.createDataFrame(rows, "kind string, value string, expected boolean")
    got = F.expr(
        "CASE kind "
        + " ".join(f"WHEN '{k}' THEN {f('value')}" for k, f in KIND_VALID.items())
        + " END"
    )
    wrong = df.filter(~got.eqNullSafe(F.col("expected"))).collect()
    assert wrong == []


def test_profile_counts_valid_invalid_and_other_shapes(spark):
    df = spark.createDataFrame(
        [
            ("110101199003078515", "6222021000112230"),
            ("110101199003078514", "abc"),
            (None, "6222021000112231"),
        ],
        "a string, b string",
    )
    rows = {r.kind: tuple(r)[1:] for r in checksum_profile(df, {"a": "id_card", "b": "bank_card"}).collect()}
    assert rows == {"id_card": (1, 1, 0), "bank_card": (1, 1, 1)}
