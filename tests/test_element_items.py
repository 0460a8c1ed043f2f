"""Elements of odd lists, against a plain loop; each list is read by one cast, and fields are worked out once."""

import json
import random

from sparloom.plans import extraction

LOOKS = ("color", "material", "shape", "location")
WHITE = " \t\n　"


def text_of(value):
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    return (value if isinstance(value, str) else json.dumps(value, separators=(",", ":"))).strip(WHITE)


def made(rng):
    text = lambda: rng.choice(["", " a ", "　hat\n", "{x}", "a long text of many words", 7, True, None, ["a"], {"k": 1}])
    if rng.random() < 0.15:
        return rng.choice([None, "text", 3, [], {}, [{"name": "x"}]])
    item = {k: text() for k in ("name", "value", "description") if rng.random() < 0.7}
    item |= {"category": rng.choice(["Skin-Body", " hair ", "cape", 5, None]), "confidence": rng.choice(["0.95", "Very_High", " low", "odd", 0.9, None])}
    item["attributes"] = rng.choice([{k: text() for k in rng.sample(LOOKS, 2)}, {"color": "red "}, "none", None, []])
    return {k: v for k, v in item.items() if rng.random() < 0.9}


def wanted(sample, items):
    for k, x in enumerate(items):
        x = x if isinstance(x, dict) else {}
        n, said = text_of(x.get("name")), text_of(x.get("value") if x.get("value") is not None else x.get("description"))
        if n or said:
            category = text_of(x.get("category")).lower().replace("-", "_").replace(" ", "_")
            sure = text_of(x.get("confidence")).lower().replace("_", " ")
            look = x.get("attributes") if isinstance(x.get("attributes"), dict) else {}
            label = sure if sure in ("high", "medium", "low") else "high" if sure in ("very high", "0.9", "0.95", "1.0") else "medium"
            yield (sample, f"{sample}_e{k + 1:03d}", n or said[:20], said or n, category if category in ("skin_body", "hair") else "other", *[text_of(look.get(a)) for a in LOOKS], label)


def test_odd_items(spark):
    rng = random.Random(9)
    lists = [[made(rng) for _ in range(rng.randrange(6))] for _ in range(150)] + [[{"name": "n"}] * 1001]
    forms = ("%s", "```json\n%s\n```", "Sure: %s - done.", "　```\n%s```\n", "no {, then %s")
    body = lambda i, x: json.dumps({("elements", "extracted_elements", "atomic_rules")[i % 3]: x})
    rows = [(f"s{i}", forms[i % 4] % body(i, x)) for i, x in enumerate(lists)] + [("bad", forms[4] % body(0, [{"name": "n"}])), ("none", None), ("open", 'see {"elements": ['), ("word", "true"), ("two", "} {")]
    got = extraction.elements(spark.createDataFrame(rows, "sample_id string, answer string"))
    want = [r for i, x in enumerate(lists) for r in wanted(f"s{i}", x)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 1200


def test_lists_are_cast_once(spark):
    found = extraction.as_rules(extraction.elements(spark.createDataFrame([("s", "{}")], "sample_id string, answer string")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$.elements") == 1 and "$.name" not in plan and "$.attributes.color" not in plan
