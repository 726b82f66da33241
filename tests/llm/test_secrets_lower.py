import pytest

from quillgrid.llm import secrets


@pytest.mark.parametrize("text", ["pwd: qzjxkvwmtrplbn", "passphrase=correcthorsebatterystaple", "private_key: qzjxkvwmtrplbn", "credentials => 'qzjxkvwmtrplbn'", "bearer := qzjxkvwmtrplbn"])
def test_small_letters_after_a_separator_are_costed(text):
    (start, end, kind), *rest = secrets.spans(text)[1]
    assert not rest and kind == "value" and text[start:end] in ("qzjxkvwmtrplbn", "correcthorsebatterystaple")


@pytest.mark.parametrize("text", ["pwd: changeme", "passphrase=aaaaaaaaaaaaaa", "pwd: qwertyuiop", "the credentials were unquestionably good", "the bearer is extraordinarily late"])
def test_cheap_values_and_prose_are_not_reported(text):
    assert secrets.spans(text) == ([], [])
