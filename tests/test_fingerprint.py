import json

import pytest

from lexiform.functions import fingerprint as fp


def test_canonical_json():
    # U+1F642 begins with a lower UTF-16 unit than U+FB01.
    assert fp.canonical({"b": [1, True, None], "a": "é\n", "\ufb01": 2, "\U0001f642": 1}) == '{"a":"é\\n","b":[1,true,null],"\U0001f642":1,"\ufb01":2}'
    cases = {0.0: "0", -0.0: "0", 1.0: "1", 1.5: "1.5", 1e21: "1e+21", 1e20: "100000000000000000000", 1e-6: "0.000001", 1e-7: "1e-7", 123456.789: "123456.789", -2.5e-9: "-2.5e-9", 5e-324: "5e-324", 0.1: "0.1", 1.7976931348623157e308: "1.7976931348623157e+308"}
    for x, want in cases.items():
        assert fp.canonical(x) == want and json.loads(want) == x
    for bad in (float("nan"), float("inf"), 1 << 60, {1: 2}, {1, 2}):
        with pytest.raises(ValueError):
            fp.canonical(bad)


def test_every_field_counts():
    base = {k: "x" for k in fp.FIELDS}
    seen = {fp.semantic(base)}
    for k in fp.FIELDS:
        for v in (None, "", "y", 1, True, b"x" * 32):
            seen.add(fp.semantic(base | {k: v}))
    assert len(seen) == 1 + 6 * len(fp.FIELDS)
    with pytest.raises(ValueError):
        fp.semantic({k: 1 for k in fp.FIELDS[1:]})


def test_files():
    doc = {"model": {"type": "BPE"}, "added_tokens": [{"id": 1, "content": "a"}, {"id": 2, "content": "b"}]}
    one = fp.of_file(json.dumps(doc).encode())
    assert one != fp.of_file(json.dumps(doc | {"added_tokens": doc["added_tokens"][::-1]}).encode())
    assert fp.pipeline(doc) == fp.pipeline(doc | {"added_tokens": []}) == fp.pipeline({"decoder": None} | doc)
    assert fp.pipeline(doc) != fp.pipeline(doc | {"decoder": {}})
