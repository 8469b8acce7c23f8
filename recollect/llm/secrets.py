"""Credentials embedded in source code, configuration and tool output.

Method: a text is scanned for credentials, and every literal in it that may be an encoding
(base64, hex, percent, backslash or JSON escapes) is decoded and scanned again, layer by
layer until nothing decodes; each layer is shorter than the one around it.  Percent and
backslash escapes, and literals in pieces, are decoded where they stand, so that the names
and words around a value count as its context.  Key material is recognised by the binary grammar of its container: DER sequences
of private keys, OpenSSH's length-prefixed records, JSON web tokens.  What is found in a
decoded layer redacts the whole encoded literal around it; what is found in the text
itself redacts the secret's characters only, so quotes, keys and structure stay and the
code, configuration or JSON around it still parses.

Not credentials: references to a stored secret, masked and dummy values, checksums, ids,
public keys, certificates, and settings whose names only sound like secrets.
"""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions.arrow import task_mapper

PLACEHOLDER = "REDACTED"

Span = tuple[int, int]

# --- values -----------------------------------------------------------------------------

#: What stands where a secret would.
_DUMMY = re.compile(
    r"^(?:\W*|[*•.xX#-]{3,}|<[^<>]*>|\[[^\[\]]*\]|\$\{?[\w.:-]+\}?|%(?:[A-Z_][A-Z0-9_]*|[a-z_]+)%|\{\{.*|.*\}\}|\$\(.*|.*(?:your|example|placeholder|changeme|change[-_]me|replace[-_]?me|dummy|redacted|masked|removed|todo|insert|fake|sample|not[-_]?set|enter[-_]).*"
    r"|x{4,}.*|none|null|nil|true|false|undefined|empty|secret|password|passwd|token|bearer|basic|string|required|optional|hidden|(?:test|demo|foo|bar|abc|pass|user|admin|root)[\w-]{0,4}|(\w)\1*|1234\w*)$",
    re.I,
)
_REFERENCE = re.compile(r"^(?:os\.|process\.|env\b|env[.\[(]|getenv|config[.\[(]|settings[.\[(]|vault[.:/]|keyring|secrets?[.\[(:/]|ssm:|arn:|aws[-_]?sm|op://|ref\+|file:|/run/|/etc/|/var/|self\.|this\.|load\(|read\(|get\w*\(|\w+\(|input|\w+\.\w+\()", re.I)


_name_part = re.compile(r"[A-Z]{2,}(?![a-z])|[A-Z]?[a-z]+|[A-Z]")
_soft = re.compile(r"[aeiouy]", re.I)
_CODE = re.compile(r"[A-Z]{16,40}")
_vowels = re.compile("[AEIOU]")


def entropy(value: str) -> float:
    """Bits per character of the value's own letters."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def _is_name(value: str) -> bool:
    """Letters that read as the words of a name, in camel case or joined by marks."""
    parts = [x for piece in re.split(r"[_-]", value) for x in _name_part.findall(piece)]
    words = [x for x in parts if len(x) > 2 and not x.isupper()]
    return len(parts) - len(words) <= 1 and all(0.2 <= len(_soft.findall(x)) / len(x) <= 0.75 for x in words)


def _is_real(value: str) -> bool:
    return not _DUMMY.match(value) and not _REFERENCE.match(value)


def _is_password(value: str) -> bool:
    """Could someone log in with it?  Letters together with digits or marks, or encoded so."""
    if len(value) < 6 or not _is_real(value) or any(c.isspace() for c in value):
        return False
    letters = any(c.isalpha() for c in value)
    others = any(c.isdigit() for c in value) or any(c in "!@#$%^&*?~+=" for c in value)
    # words joined by marks, paths and file names are names of things
    if re.fullmatch(r"[a-z]+(?:[-_.:/][a-z]+)*", value) or re.fullmatch(r"(?:[\w.-]+/)+[\w.-]+\.\w+", value):
        return False
    # letters alone: capitals where no word, name or camel case has them
    mixed = any(c.islower() for c in value) and any(c.isupper() for c in value[1:]) and not _is_name(value)
    return letters and (others or mixed and len(value) >= 8 and entropy(value) > 2.5)


def _is_key(value: str) -> bool:
    """Long and irregular enough for an issued key or token."""
    if len(value) < 16 or not _is_real(value) or not re.fullmatch(r"[\w.~+/=-]+", value):
        return False
    digits = sum(c.isdigit() for c in value)
    code = bool(_CODE.fullmatch(value)) and len(_vowels.findall(value)) < 0.35 * len(value)
    if digits == 0 and not code and not (any(c.islower() for c in value) and any(c.isupper() for c in value)):
        return False
    if re.fullmatch(r"[\d.:TZ+-]+", value) or re.fullmatch(r"(?:[\w.-]+/)+[\w.-]+\.\w{1,5}", value):
        return False
    return entropy(value) > (2.6 if re.fullmatch(r"[0-9a-fA-F]+", value) else 3.0) and digits + sum(c.isupper() for c in value) >= 3


# --- containers -------------------------------------------------------------------------


def _der(data: bytes, at: int = 0) -> tuple[int, int, int] | None:
    """(tag, start, end) of the DER element at ``at``; None if it isn't one."""
    if at + 2 > len(data):
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > len(data):
            return None
        n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if n < 0x80:
            return None
    return (tag, at, at + n) if at + n <= len(data) else None


def _children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    out = []
    while start < end:
        x = _der(data[:end], start)
        if x is None:
            return None
        out.append(x)
        start = x[2]
    return out


def container(data: bytes) -> str:
    """'private', 'public' or '' for a key container, by its grammar.

    RSA, EC and PKCS#8 private keys are sequences that begin with a version number and hold
    integers, an octet string or an algorithm and an octet string; certificates and public
    keys begin with a sequence.  OpenSSH keys begin with their magic string.
    """
    if data.startswith(b"openssh-key-v1\x00"):
        return "private"
    if data[:4] == b"\x00\x00\x00\x07" and data[4:8] == b"ssh-" or data[:4] == b"\x00\x00\x00\x0b" and data[4:8] == b"ssh-":
        return "public"
    top = _der(data)
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return ""
    parts = _children(data, top[1], top[2])
    if not parts or len(parts) < 2:
        return ""
    tags = [p[0] for p in parts]
    if tags[0] == 0x02 and data[parts[0][1] : parts[0][2]] in (b"\x00", b"\x01"):
        if len(tags) >= 8 and all(t == 0x02 for t in tags[:9]) or tags[1] == 0x04 or tags[1] == 0x30 and 0x04 in tags:
            return "private"
    if tags[0] == 0x30 and tags[1] == 0x04:
        return "private"  # an encrypted PKCS#8 key
    return "public" if tags[0] == 0x30 else ""


def _web_token(value: str) -> bool:
    """A JSON web token: three parts, the first of which is a header."""
    parts = value.split(".")
    if len(parts) not in (3, 5) or len(parts[-1]) < 10:
        return False
    header = _base64(parts[0])
    try:
        return isinstance(x := json.loads(header or b""), dict) and ("alg" in x or "typ" in x)
    except ValueError:
        return False


# --- plain credentials ------------------------------------------------------------------

_pem = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY(?: BLOCK)?-----(.*?)(?:-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----|$)", re.S)
_public_block = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*(?:PUBLIC KEY|CERTIFICATE(?: REQUEST)?)-----.*?-----END [A-Z0-9 ]+-----", re.S)
_public_line = re.compile(r"ssh-(?:ed25519|rsa|dss) [A-Za-z0-9+/=]+|ecdsa-sha2-\w+ [A-Za-z0-9+/=]+|sha(?:1|224|256|384|512)[-:][ ]?[A-Za-z0-9+/=]+")
_jwt = re.compile(r"(?<![\w-])eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{10,}")
#: Issued tokens that say so themselves: a short issuer's mark, then a long random part.
_issued = re.compile(
    r"(?<![A-Za-z0-9_/+.-])(?:"
    r"[a-z]{2,6}(?:[-_](?:live|prod|test|pat|key|sk|v\d))?[-_](?=[A-Za-z]*\d)[A-Za-z0-9]{20,}"  # ab-..., abc_live_...
    r"|(?:AKIA|ASIA|AIza)[A-Za-z0-9_-]{16,}"
    r"|[A-Z]{3,4}[A-Z2-7]{16,17}"  # a mark and base32, 20 in all
    r"|[0-9a-f]{8}\.[A-Za-z0-9]{22}"  # id and secret
    r")(?![A-Za-z0-9_/+=.-]*[A-Za-z0-9_/+])"
)
_random = re.compile(r"(?<![A-Za-z0-9_/+.=@-])[A-Za-z0-9]{40}(?![A-Za-z0-9_/+=-])")
_url = re.compile(r"\b[a-z][a-z0-9+.-]*://[^\s:/@'\"<>]*:([^\s@/'\"<>]+)@", re.I)
#: A database client's password, written against its flag.
_attached = re.compile(r"\s-u\s?[\w.@-]+\s(?:[^\n]*?\s)??-p(?P<v>[^\s'\"]{6,})|\b(?:mysql\w*|mariadb[\w-]*|sshpass)\s(?:[^\n]*?\s)??-p\s?(?P<w>[^\s'\"]{6,})")
_curl_user = re.compile(r"(?:\s-u|--user)[ =]['\"]?[^\s:'\"]+:([^\s'\"]+)")
_basic = re.compile(r"\bBasic ([A-Za-z0-9+/]{8,}={0,2})")
_bearer = re.compile(r"\b(?:Bearer|Token) ([\w.~+/=-]{16,})")
_query = re.compile(r"[?&](?:access_token|api_?key|key|token|auth|sig|signature|secret|password|client_secret)=([^&\s'\"#]+)", re.I)

_VALUE = r"(?:b?(?P<q>['\"`])(?P<quoted>(?:(?!(?P=q)).)*)(?P=q)|(?P<bare>[^\s'\"`,;)}\]]+(?:[ ](?=\()[^\n]*)?))"
_GIVES = r"['\"]?\s*(?:=>|:=|[:=])\s*\(?\s*"
#: The end of a name that a value follows; the rest of the name stands before it.
_assigned_password = re.compile(r"(?:passwords?|passwd|passphrase|pass|pwd|pw)" + _GIVES + _VALUE, re.I)
_assigned_key = re.compile(r"(?:secret[\w-]*|tokens?|keys?|credentials?|auth|pat|hmac|signing)" + _GIVES + _VALUE, re.I)
_password_name = re.compile(r"pass|pwd|pw$", re.I)
_key_name = re.compile(r"secret|token|api[-_]?keys?$|apikey|access[-_]?key|private[-_]?key|signing|encryption[-_]?key|credential|auth|[_-]key$|^key$|[a-z]Key$|(?:^|[_-])pat$|hmac", re.I)
_spoken = re.compile(r"\b(?:password|passwd|passphrase|pwd|secret|pin)(?: is| was|:)? ['\"`]?(?P<v>[^\s'\"`,;]+)", re.I)
#: Sentences that hand over a key.
_handed = re.compile(r"\b(?:accept(?:s|ed)|issued|rotated to|authenticated with|(?:token|key|secret|credential)(?: for \w+)? is) ['\"`]?(?P<v>[\w.~+/=-]{16,}?)(?=['\"`,;]|\.?(?:\s|$))", re.I)
_flag = re.compile(r"--(?:password|passwd|pass|token|api-key|secret|auth-token|access-key)[ =]['\"]?(?P<v>[^\s'\"]+)", re.I)
_attribute = re.compile(r"(?:name|key)=\"(?P<n>[^\"]*)\" value=\"(?P<v>[^\"]+)\"(?P<k>[^<>\n]*)")
_header = re.compile(r"\b(?:X-[\w-]*(?:Key|Token|Secret)|Authorization|Api-Key|Private-Token)['\"]?\s*[:=]\s*['\"]?(?!Basic |Bearer |Token )(?P<v>[\w.~+/=-]{12,})", re.I)
_byte_key = re.compile(r"\b(?:sign|hmac|encrypt|decrypt|digest|verify|mac|cipher)\w*\([^()\n]*?b?['\"](?P<v>[A-Za-z0-9+/_=-]{16,})['\"]", re.I)
_joined = re.compile(r"(['\"])((?:(?!\1).)*)\1\s*(?:\+\s*)?\n?\s*(?:\+\s*)?(?=\1)")
_names_only = re.compile(r"(?:secret_name|token_type|password_field|max_tokens|token_count|key_id|public_key|integrity|etag|checksum|digest|fingerprint|commit|sha\d*|md5|hash)['\"]?\s*[:=]", re.I)
_benign_name = re.compile(r"(?:_name|_type|_field|_id|_path|_file|_url|_env|_ref|_count|_limit|_length|_size|_ttl|_expiry|_header|_policy|_hint|max_\w+|num_\w+|public\w*)['\"]?$", re.I)
_checksum_line = re.compile(r"(?:etag|integrity|checksum|digest|fingerprint|commit|sha\d{0,3}|md5|hash|revision|tree|parent|blob|object|uuid|trace|request|span|build|image|version|ref)\b[^\n]{0,12}$", re.I)

#: What every credential or encoding has one of, in lower case; long runs apart.
_HINTS = "pass pw secret token key auth cred bearer basic private pat hmac sign :// -u  % \\u \\x pin".split(" ")
_runs = re.compile(r"[A-Za-z0-9]+")
_packed = re.compile(r"[A-Za-z0-9+/=]{24}|(?:[0-9a-fA-F]{2}[ :]){9}")


def _long_run(text: str) -> bool:
    """No issued token, encoding or key is without a run of letters and digits of some length."""
    return max(map(len, _runs.findall(text)), default=0) >= 14 or ("+" in text or ": " in text or ":" in text) and bool(_packed.search(text))


def _hinted(text: str) -> bool:
    lower = text.lower()
    return any(h in lower for h in _HINTS if h) or _long_run(text)


def _plain(text: str) -> list[Span]:
    """Credentials that stand in the text as they are."""
    lower = text.lower()
    long = _long_run(text)
    password = "pass" in lower or "pw" in lower
    found: list[Span] = []
    public: list[Span] = []
    if "-----begin" in lower:
        found += [m.span(2) for m in _pem.finditer(text) if len(m[2].strip()) > 20]
        public += [m.span() for m in _public_block.finditer(text)]
    if long and ("ssh-" in lower or "sha" in lower):
        public += [m.span() for m in _public_line.finditer(text)]
    barred = lambda a, b: any(x < b and a < y for x, y in public)

    def add(a: int, b: int) -> None:
        if b > a and not barred(a, b):
            found.append((a, b))

    def low(start: int) -> str:
        return text[text.rfind("\n", 0, start) + 1 : start]

    if long:
        for m in _jwt.finditer(text) if "eyJ" in text else ():
            if _web_token(m[0]):
                add(*m.span())
        for m in _issued.finditer(text):
            if _is_key(m[0]) and not _checksum_line.search(low(m.start())):
                add(*m.span())
        for m in _random.finditer(text):
            v = m[0]
            if any(c.isdigit() for c in v) and any(c.islower() for c in v) and any(c.isupper() for c in v) and entropy(v) > 4 and not _checksum_line.search(low(m.start())):
                add(*m.span())
        for m in _handed.finditer(text) if "accept" in lower or " is " in lower or "issued" in lower or " with " in lower or "rotated" in lower else ():
            if _is_key(m["v"]):
                add(*m.span("v"))
        for m in _bearer.finditer(text):
            if _is_key(m[1]):
                add(*m.span(1))
        for m in _byte_key.finditer(text):
            if _is_key(m["v"]):
                add(*m.span("v"))
    for m in _url.finditer(text) if "://" in text and "@" in text else ():
        if _is_real(m[1]):
            add(*m.span(1))
    for m in _curl_user.finditer(text) if "-u" in text else ():
        if _is_real(m[1]) and len(m[1]) >= 6:  # what stands there is a password
            add(*m.span(1))
    for m in _attached.finditer(text) if " -p" in text else ():
        group = "v" if m["v"] else "w"
        if _is_password(m[group]) or _is_key(m[group]):
            add(*m.span(group))
    for m in _basic.finditer(text) if "Basic " in text else ():
        user = _base64(m[1])
        if user and b":" in user and user.isascii() and _is_real(user.decode().partition(":")[2]):
            add(*m.span(1))
    for m in _query.finditer(text) if "?" in text or "&" in text else ():
        if _is_key(m[1]) or _is_password(m[1]) and len(m[1]) >= 8:
            add(*m.span(1))
    for regex, good in ((_assigned_password, _is_password), (_assigned_key, _is_key)):
        if good is _is_password and not password:
            continue
        for m in regex.finditer(text):
            group = "quoted" if m["q"] else "bare"
            value = m[group]
            if len(value) < 6 or not (good(value) or good is _is_password and _is_key(value)):
                continue
            # all of the name, of which the pattern matched the end
            start = m.start()
            while start and (text[start - 1].isalnum() or text[start - 1] in "_.-"):
                start -= 1
            name = re.split(r"['\"]?\s*[:=]", text[start : m.end()], maxsplit=1)[0]
            if _names_only.match(text, start) or _benign_name.search(name) or good is _is_key and not _key_name.search(name):
                continue
            add(*m.span(group))
    for m in _flag.finditer(text) if "--" in text else ():
        if _is_password(m["v"]) or _is_key(m["v"]):
            add(*m.span("v"))
    for m in _spoken.finditer(text) if password or "secret " in lower or "pin " in lower else ():
        v = m["v"].rstrip(".")
        if _is_password(v):
            add(m.start("v"), m.start("v") + len(v))
    for m in _attribute.finditer(text) if 'value="' in text else ():
        if re.search(r"secret|password|token|key|hmac|sign", m["n"] + m["k"], re.I) and (_is_key(m["v"]) or re.search("pass", m["n"], re.I) and _is_password(m["v"])):
            add(*m.span("v"))
    for m in _header.finditer(text) if "x-" in lower or "authorization" in lower or "-key" in lower or "-token" in lower else ():
        if _is_key(m["v"]) or _is_password(m["v"]) and len(m["v"]) >= 12:
            add(*m.span("v"))
    return found


# --- encoded layers ---------------------------------------------------------------------

_base64_run = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/]{16,}={0,2}|[A-Za-z0-9_-]{16,}={0,2})(?![A-Za-z0-9+/_=-])")
#: Base64 broken into lines: at least one full line, then the last.
_wrapped = re.compile(r"^[ \t]*[A-Za-z0-9+/]{40,}[ \t]*\r?\n(?:[ \t]*[A-Za-z0-9+/]{40,}[ \t]*\r?\n)*+[ \t]*[A-Za-z0-9+/]+={0,2}[ \t]*$", re.M)
_hex_run = re.compile(r"(?<![A-Za-z0-9])(?:0x)?((?:[0-9a-fA-F]{2}){10,})(?![A-Za-z0-9])")
_spaced_hex = re.compile(r"(?<![A-Za-z0-9])[0-9a-fA-F]{2}(?:[ :][0-9a-fA-F]{2}){9,}(?![A-Za-z0-9])")
_percent_word = re.compile(r"[^\s'\"<>]++")
_percent_code = re.compile(r"%[0-9A-Fa-f]{2}")
_percent_chain = re.compile(r"%(?:25)+(?=[0-9A-Fa-f]{2})")
_escape_word = re.compile(r"[^\s'\"]++")
_escape = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\([0-7]{3})")
_escape_chain = re.compile(r"\\(?:u005[cC]|x5[cC])+(?=[ux])")
_literal = re.compile(r'"(?:[^"\\]|\\.)*"')


def _base64(value: str) -> bytes | None:
    try:
        return base64.b64decode(value.replace("-", "+").replace("_", "/").rstrip("=") + "=" * (-len(value.rstrip("=")) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _as_text(data: bytes | None) -> str | None:
    """Decoded bytes if they read as text."""
    if not data:
        return None
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return text if all(c.isprintable() or c in "\n\r\t" for c in text) else None


def _percent(value: str) -> str | None:
    data = re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), _percent_chain.sub("%", value).encode())
    try:
        return data.decode()
    except UnicodeDecodeError:
        return None


def _unescape(value: str) -> str:
    return _escape.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else chr(int(m[3], 8)), _escape_chain.sub(r"\\", value))


def _within(text: str, literals: list[tuple[int, int, str]]) -> list[int]:
    """Which of the literals (start, end, what it stands for) hold a credential.

    All are decoded where they stand and the text is scanned again once.
    """
    parts, places, at, size = [], [], 0, 0
    for a, b, inner in literals:
        parts += [text[at:a], inner]
        size += a - at
        places.append((size, size + len(inner)))
        size, at = size + len(inner), b
    hits = spans("".join([*parts, text[at:]]))
    out, h = [], 0
    for n, (x, y) in enumerate(places):
        while h < len(hits) and hits[h][1] <= x:
            h += 1
        if h < len(hits) and hits[h][0] < y:
            out.append(n)
    return out


def _encoded(text: str) -> list[Span]:
    """Literals that hold a credential in a layer below."""
    found: list[Span] = []
    for mark, word, code, decode in (("\\", _escape_word, _escape, _unescape), ("%", _percent_word, _percent_code, _percent)):
        if mark in text and code.search(text):
            literals = [(m.start(), m.end(), x) for m in word.finditer(text) if code.search(m[0]) and (x := decode(m[0])) and len(x) < len(m[0])]
            if literals:
                found += [literals[n][:2] for n in _within(text, literals)]
    if not _long_run(text):
        return found

    def holds(data: bytes | None) -> bool:
        if data is None:
            return False
        inner = _as_text(data)
        return len(inner) >= 8 and bool(spans(inner)) if inner is not None else len(data) > 60 and container(data) == "private"

    found += [m.span() for m in _base64_run.finditer(text) if holds(_base64(m[0]))]
    if "\n" in text:
        found += [m.span() for m in _wrapped.finditer(text) if holds(_base64("".join(m[0].split())))]
    for regex, group in ((_hex_run, 1), (_spaced_hex, 0)):
        found += [m.span() for m in regex.finditer(text) if holds(_unhex(m[group]))]
    return found


def _unhex(value: str) -> bytes | None:
    try:
        return bytes.fromhex(re.sub(r"[ :]", "", value))
    except ValueError:
        return None


_adjacent = re.compile(r"(['\"])\s*(?:[+.\\]\s*)?\1[A-Za-z0-9]")
_between = re.compile(r"\s*(?:[+.\\]\s*)?")
_names_value = re.compile(r"\s*:")
_text_literal = re.compile(r"(['\"])((?:(?!\1|\n).)*)\1")


def _pieces(text: str) -> list[Span]:
    """A secret cut into adjacent string literals: found in the joined text, redacted in each."""
    runs: list[list[re.Match]] = []
    for m in _text_literal.finditer(text):
        if runs and runs[-1][-1][1] == m[1] and _between.fullmatch(text, runs[-1][-1].end(), m.start()) and not _names_value.match(text, m.end()):
            runs[-1].append(m)
        else:
            runs.append([m])
    runs = [run for run in runs if len(run) > 1]
    if not runs:
        return []
    # what stands between the first literal's quotes is all that the run says
    literals = [(run[0].start(2), run[-1].end(2), "".join(m[2] for m in run)) for run in runs]
    return [m.span(2) for n in _within(text, literals) for m in runs[n] if m[2]]


def spans(text: str) -> list[Span]:
    """Spans of credentials and of encoded literals that hold one, in order, disjoint."""
    found = _plain(text) + _encoded(text)
    if ("(" in text or "+" in text or "\\" in text) and text.count("'") + text.count('"') >= 4 and _adjacent.search(text):
        found += _pieces(text)
    out: list[Span] = []
    for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
        if out and a < out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def redact(text: str | None) -> tuple[str | None, int]:
    """(text, number of secrets): the text with its secrets replaced.

    JSON stays JSON: its string literals are decoded, redacted and written again, and only
    those that held a secret change.  Other text keeps all but the secrets' characters.
    """
    if not text or not _hinted(text):
        return text, 0
    if text.lstrip()[:1] in ("{", "["):
        try:
            json.loads(text)
        except (ValueError, RecursionError):
            pass
        else:
            return _redact_json(text)
    return _redact_plain(text)


def _redact_plain(text: str) -> tuple[str, int]:
    out, at, found = [], 0, spans(text)
    for a, b in found:
        lines = text[a:b].count("\n")
        out += [text[at:a], "\n" * (lines > 0) + PLACEHOLDER + "\n" * (lines > 0) if text[a : a + 1] == "\n" else PLACEHOLDER]
        at = b
    return "".join([*out, text[at:]]), len(found)


def _redact_json(text: str) -> tuple[str, int]:
    out, at, n = [], 0, 0
    name = ""
    for m in _literal.finditer(text):
        if _names_value.match(text, m.end()):
            name = m[0][1:-1]
            continue
        value = json.loads(m[0])
        clean, k = redact(value)
        if not k and (_key_name.search(name) or _password_name.search(name)) and text[: m.start()].rstrip().endswith(":"):
            # the name in front of a value is part of its context
            head = f"{name}: "
            if [s for s in spans(f'{head}"{value}"') if s[1] > len(head)]:
                clean, k = PLACEHOLDER, 1
        if k:
            out += [text[at : m.start()], json.dumps(clean, ensure_ascii=m[0].isascii())]
            at, n = m.end(), n + k
    return "".join([*out, text[at:]]), n


def has_credential(text: str | None) -> bool:
    return redact(text)[1] > 0


# --- over tables ------------------------------------------------------------------------


def event_fields(events: DataFrame) -> DataFrame:
    """(rel, row_key, field, text): arguments and results of agent events that aren't empty."""
    both = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("args_json", "result")))
    return (
        events.where("id is not null and (args_json <> '' or result <> '')")
        .select(F.col("id").cast("string").alias("row_key"), F.explode(both).alias("x"))
        .where("x.text is not null and x.text <> ''")
        .select(F.lit("agent_events").alias("rel"), "row_key", "x.field", "x.text")
    )


def change_fields(raw: DataFrame) -> DataFrame:
    """(rel, row_key, field, text): the after-texts of the events in payloads.

    The key is ``umsf_id:n`` with the event's position.  Payloads that aren't valid JSON have
    none.
    """
    from recollect.operators.nested import parse

    def after(keys: list, payloads: list):
        out: tuple[list, list] = ([], [])
        for key, payload in zip(keys, payloads):
            if key is None:
                continue
            try:
                document = parse(payload)
            except ValueError:
                continue
            events = document.get("events") if isinstance(document, dict) else None
            for n, event in enumerate([events] if isinstance(events, dict) else events if isinstance(events, list) else []):
                text = event.get("after") if isinstance(event, dict) else None
                if isinstance(text, (dict, list)):
                    text = json.dumps(text, ensure_ascii=False)
                if isinstance(text, str) and text:
                    out[0].append(f"{key}:{n}")
                    out[1].append(text.encode("utf-8", "replace").decode())
        return out

    rows = task_mapper(raw, [F.col("umsf_id"), F.col("payload")], "row_key string, text string", lambda: after)
    return rows.select(F.lit("umsf_raw").alias("rel"), "row_key", F.lit("after").alias("field"), "text")


def fields_with_credentials(fields: DataFrame) -> DataFrame:
    """(rel, row_key, field): the fields that hold a credential, each once."""

    def make() -> Callable:
        def f(rels: list, keys: list, names: list, texts: list):
            hits = [x[:3] for x in zip(rels, keys, names, texts) if has_credential(x[3])]
            return tuple(list(c) for c in zip(*hits)) if hits else ([], [], [])

        return f

    columns = [F.col(c) for c in ("rel", "row_key", "field", "text")]
    return task_mapper(fields, columns, "rel string, row_key string, field string", make).distinct()


def redact_fields(fields: DataFrame) -> DataFrame:
    """(rel, row_key, field, text, secrets): the same texts, redacted; clean ones unchanged."""

    def make() -> Callable:
        def f(rels: list, keys: list, names: list, texts: list):
            done = [redact(t) for t in texts]
            return rels, keys, names, [t for t, _ in done], [n for _, n in done]

        return f

    columns = [F.col(c) for c in ("rel", "row_key", "field", "text")]
    return task_mapper(fields, columns, "rel string, row_key string, field string, text string, secrets int", make)
