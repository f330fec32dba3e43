"""Regular expressions of the detectors, in Java syntax.

Three rules shape every pattern, so that results do not depend on the engine:

* word boundaries are ASCII.  Java's ``\\b`` counts accented letters as word
  characters, so boundaries are spelled out with look-around.
* white space is the full Unicode set, because Java's ``\\s`` is ASCII only.
* no pattern may recurse or rescan without bound.  Runs are possessive and
  may start only at the start of a run, so one hostile text cannot blow the
  stack of an executor or hold a task for hours.

A look-behind placed *after* the first character (``\\d(?<!\\w\\d)``) means the
same as one placed before it, but is tried only where that character occurs.

Classes on the hot path list their characters one by one: Java turns such a
class into one table lookup, while a class of ranges becomes a chain of
predicates (four times slower on the token runs).
"""

from __future__ import annotations

import string

ALPHANUMERIC = string.ascii_letters + string.digits

# --- fixed values: character classes -----------------------------------------
WORD = r"\w"
SPACE = (
    r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
MAILBOX = f"[{ALPHANUMERIC}.!#$%&'*+/=?^_`{{|}}~-]"
HOST_LABEL = "[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
TOKEN_CHAR = f"[{ALPHANUMERIC}+/=_-]"
BASE64URL = r"[\w-]"

NOT_IN_WORD = f"(?<!{WORD})"
WORD_ENDS = f"(?!{WORD})"

# --- fixed values: patterns --------------------------------------------------
EMAIL = rf"(?:\G|(?<!{MAILBOX})){MAILBOX}++@{HOST_LABEL}(?:\.{HOST_LABEL})*+"

PHONE = rf"\+[1-9]\d{{0,2}}[{SPACE}.-]?\(?\d{{1,4}}\)?[{SPACE}.-]?\d{{1,4}}[{SPACE}.-]?\d{{2,9}}"

SSN = rf"\d(?<!{WORD}\d)\d{{2}}-\d{{2}}-\d{{4}}{WORD_ENDS}"

# 13 to 19 digits: separators may stand between the first 13, after those the
# number ends at the first one
CARD = rf"\d(?<!{WORD}\d)(?:[ -]*+\d){{12}}\d{{0,6}}+{WORD_ENDS}"

AWS_ACCESS_KEY = rf"AKIA(?<!{WORD}AKIA)[0-9A-Z]{{16}}{WORD_ENDS}"

AWS_SECRET_KEY = (
    rf"(?:aws_secret_access_key|AWS_SECRET_ACCESS_KEY)[\"']?[{SPACE}]*+[=:]"
    rf"[{SPACE}]*+[\"']?([A-Za-z0-9/+=]{{40}})"
)

GITHUB_PAT = rf"{NOT_IN_WORD}(?:ghp_[A-Za-z0-9]{{36}}|github_pat_[A-Za-z0-9_]{{22,}}+){WORD_ENDS}"

STRIPE_KEY = rf"{NOT_IN_WORD}(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{{20,}}+{WORD_ENDS}"

GOOGLE_API_KEY = rf"AIza(?<!{WORD}AIza){BASE64URL}{{35}}"

GOOGLE_OAUTH_SECRET = (
    rf"(?:client_secret|GOOGLE_CLIENT_SECRET)[\"']?[{SPACE}]*+[=:]"
    rf"[{SPACE}]*+[\"']?({BASE64URL}{{24,}}+)"
)

PRIVATE_KEY_END = r"-----END (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"
PRIVATE_KEY_BLOCK = (
    r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----[\s\S]*?" + PRIVATE_KEY_END
)
# the text up to its last end line: behind it a begin line would be searched in vain, each
# to the end of the text
UP_TO_LAST_KEY = rf"(?s)\A.*{PRIVATE_KEY_END}"

JWT_TAIL = rf"\.eyJ{BASE64URL}{{10,}}+\.{BASE64URL}{{10,}}(?<={WORD}){WORD_ENDS}"
# tried once per run of characters: the look-ahead asks for the tail behind the run, only
# then is the first `eyJ` in it looked for; the token is group 1
JWT = (
    rf"(?<!{BASE64URL})(?={BASE64URL}{{13,}}+{JWT_TAIL}){BASE64URL}*?"
    rf"((?<!{WORD})eyJ{BASE64URL}{{10,}}+{JWT_TAIL})"
)

DATABASE_URL = (
    rf"{NOT_IN_WORD}(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?)://"
    rf"[^{SPACE}'\"`,}}{{)]++"
)

TOKEN_RUN_MIN, TOKEN_RUN_MAX = 20, 200
TOKEN_RUN = rf"{TOKEN_CHAR}{{{TOKEN_RUN_MIN},{TOKEN_RUN_MAX}}}+"

# --- screens: cheap tests that every text with a match passes ----------------
# digits of a social security or card number, at least nine
NINE_DIGITS = r"\d(?:[ -]*+\d){8}"


def long_run(length: int) -> str:
    """A run of at least ``length`` token characters.

    Walks from run to run and never looks at a character twice, where searching
    for the run itself would start anew at every character.
    """
    between = f"[^{TOKEN_CHAR[1:]}"
    return rf"\A(?:{TOKEN_CHAR}{{0,{length - 1}}}+{between}++)*+{TOKEN_CHAR}{{{length}}}"
