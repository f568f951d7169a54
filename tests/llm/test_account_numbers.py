"""Account numbers before other capital words."""

import pytest

from tidewatch.llm import pii


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("IBAN ES91 2100 0418 4502 0005 1332 BIC CAIXESBB", "IBAN [IBAN] BIC CAIXESBB"),
        ("IBAN AT61 1904 3002 3457 3201 EUR", "IBAN [IBAN] EUR"),
        ("iban: GB29NWBK60161331926819 BANK ACCT", "iban: [IBAN] BANK ACCT"),
        ("IBAN DE89 3704 0044 0532 0130 01 BIC", "IBAN DE89 3704 0044 0532 0130 01 BIC"),
    ],
)
def test_account_ends(text, wanted):
    assert pii.redacted(text, [s for s in pii.find_spans(text, pii.cue_automaton()) if pii.KINDS[s[1]] == "iban"]) == wanted
