"""Values that look like secrets by shape: drawn from a seed, never real."""

import random
import string
import uuid

_R = random.Random(2024)


def mixed(n: int) -> str:
    """Lower case, capital, digit in turn, so that neither class runs on, and no character twice."""
    kinds = [_R.sample(k, -(-n // 3)) for k in (string.ascii_lowercase, string.ascii_uppercase, string.digits)]
    return "".join(kinds[i % 3][i // 3] for i in range(n))


def drawn(n: int, alphabet: str) -> str:
    """Each character of the alphabet about as often as the others."""
    return "".join(_R.sample(alphabet * (n // len(alphabet) + 1), n))


MIXED, MIXED16 = mixed(18), mixed(16)
HEX32 = drawn(32, "0123456789abcdef")
JWT = "eyJ" + mixed(17) + "." + mixed(12)
URLSAFE = mixed(20) + "_" + mixed(12)
WEAK = "meadow" + str(_R.randint(2, 9)) + "-violet-anchor"
UUID = str(uuid.UUID(int=_R.getrandbits(128), version=4))
#: Kinds in the order of the rules, each with the shortest head of its tokens.
HEADS = {
    "OpenAI-style key": "sk-", "Anthropic-style key": "sk-ant-", "AWS access key id": "AKIA", "GitHub PAT": "ghp_", "GitHub fine-grained PAT": "github_pat_",
    "GitLab PAT": "glpat-", "Slack token": "xoxb-", "Google API key": "AIza", "Stripe secret key": "sk_live_", "Stripe restricted key": "rk_live_", "npm token": "npm_",
}
PREFIXED = {kind: head + (drawn(16, string.digits) if head == "AKIA" else "q" * 24) for kind, head in HEADS.items()}
