"""A prompt with several eval markers breaks its session, even without a call after it."""

import json

from quarry.operators import transcripts
from quarry.plans import goldens


def test_prompt_with_several_markers(spark):
    names = transcripts.Names()
    say = lambda role, text: json.dumps({"type": "response_item", "payload": {"type": "message", "role": role, "content": text}})
    sessions = [("two", say("user", f"{names.marker}1 and {names.marker}2")), ("one", say("user", f"{names.marker}1 and {names.marker}1")), ("other", say("assistant", f"{names.marker}1 {names.marker}2"))]
    df = spark.createDataFrame(sessions, "session string, text string")
    got = {r.session: (r.passed, list(r.errors)) for r in transcripts.score(df, goldens.cases(spark)).collect()}
    assert got == {"two": (False, ["user evaluation prompt carries multiple eval markers; evidence must be isolated per case"]), "one": (True, []), "other": (True, [])}
