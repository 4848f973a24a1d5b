"""Payloads out of lines and back again."""

import base64
import hashlib
import json

from pyspark.sql import functions as F

from histlake.operators import artifacts

A, B = b"\x89PNG one", b"another image of some length" * 40
uri = lambda data, kind="image/png": f"data:{kind};base64,{base64.b64encode(data).decode()}"


def test_round_trip(spark):
    texts = [
        json.dumps({"content": [{"type": "input_image", "image_url": uri(A)}, {"text": f"see {uri(B, 'image/jpeg')} and {uri(A)}."}]}),
        json.dumps({"a": uri(A), "b": {"c": [uri(A), uri(A, "image/gif")]}, "é": "ü"}),
        json.dumps({"a": uri(A + b"x"), "b": uri(A + b"xyz"), "c": uri(A)}),
        json.dumps({"a": "data:image/png;base64,!!", "b": "data:image/png;base64,QQ", "c": "data:text/plain;base64,QUJD"}),
        json.dumps({"a": "data:image/png;base64,QR=="}),  # not as base64 would write it
        json.dumps({"a": "artifact://sha256/" + "0" * 64, "b": uri(A)}),
        "no json " + uri(B), "", None, json.dumps({"a": uri(A)}),
    ]
    lines = spark.createDataFrame(list(enumerate(texts)), "n int, raw string").repartition(3)
    taken = artifacts.take_out(lines).cache()
    out = {r["n"]: r["raw"] for r in taken.collect()}
    sha = lambda data: hashlib.sha256(data).hexdigest()
    assert json.loads(out[0]) == {
        "content": [
            {"type": "input_image", "image_url": {"$artifact": f"artifact://sha256/{sha(A)}", "mime_type": "image/png", "size_bytes": len(A)}},
            {"text": f"see artifact://sha256/{sha(B)};image/jpeg; and artifact://sha256/{sha(A)};image/png;."},
        ]
    }
    assert all(out[n] == texts[n] for n in (3, 4, 5, 7, 8)) and not any("base64" in out[n] for n in (0, 1, 2, 6, 9))
    stored = artifacts.payloads(taken)
    assert {r["sha256"]: (r["size_bytes"], bytes(r["content"])) for r in stored.collect()} == {sha(x): (len(x), x) for x in (A, B, A + b"x", A + b"xyz")}
    seen = {(r["n"], r["sha256"], r["mime_type"]) for r in artifacts.observations(taken, ["n"]).collect()}
    assert {x for x in seen if x[0] < 2} == {(0, sha(A), "image/png"), (0, sha(B), "image/jpeg"), (1, sha(A), "image/png"), (1, sha(A), "image/gif")}
    back = artifacts.put_back(taken.select("n", "raw"), stored, ["n"])
    assert {r["n"]: r["raw"] for r in back.collect()} == dict(enumerate(texts))
    # a payload that is gone leaves its reference
    left = artifacts.put_back(taken.select("n", "raw"), stored.where(F.col("sha256") != sha(B)), ["n"])
    assert {r["n"]: r["raw"] for r in left.where("n = 6").collect()} == {6: out[6]}
    taken.unpersist()


def test_nothing(spark):
    taken = artifacts.take_out(spark.createDataFrame([], "n int, raw string"))
    assert artifacts.payloads(taken).count() == 0 and artifacts.put_back(taken.select("n", "raw"), artifacts.payloads(taken), ["n"]).count() == 0
