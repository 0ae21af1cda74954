"""Column expressions for text: cleaning, splitting, counting, redaction.

Every function takes and returns a ``Column``; all of them are built-in
Spark expressions (JVM side, no Python worker).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Python's str.isspace() sees it, written as a Java regex class body.
PY_WS = (r"\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
# Token separators for the whitespace token counter.
TOKEN_SEP = r"[\t\n\x0B\f\r ]+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``."""
    return F.regexp_replace(_c(c), rf"\A[{PY_WS}]+|[{PY_WS}]+\z", "")


def clean_markdown(c) -> Column:
    """>=3 newlines -> 2, right-trim every line, strip, end with one newline.

    Null or empty input gives "".
    """
    t = _c(c)
    collapsed = F.regexp_replace(t, r"\n{3,}", "\n\n")
    rtrimmed = F.regexp_replace(collapsed, rf"[{PY_WS}&&[^\n]]+(?=\n|\z)", "")
    out = F.concat(py_strip(rtrimmed), F.lit("\n"))
    return F.when(t.isNull() | (t == ""), F.lit("")).otherwise(out)


def split_paragraphs(c) -> Column:
    """Split on blank lines, strip each part, drop empty parts."""
    parts = F.split(_c(c), "\n\n")
    return F.filter(F.transform(parts, lambda p: py_strip(p)), lambda p: p != "")


def split_sentences(c) -> Column:
    """Cut after . ! ? when followed by blank, newline, tab or the end; strip;
    drop empties; the whole text when nothing is left."""
    t = _c(c)
    parts = F.filter(F.transform(F.split(t, r"(?<=[.!?])(?=[ \n\t])"), lambda p: py_strip(p)),
                     lambda p: p != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(t))


def tokens(c) -> Column:
    """Whitespace tokens of a text (empty array for empty or null text)."""
    t = F.coalesce(_c(c), F.lit(""))
    return F.filter(F.split(t, TOKEN_SEP), lambda x: x != "")


def token_count(c) -> Column:
    """Whitespace token count; 0 for empty text."""
    return F.size(tokens(c)).cast("long")


def token_usage_estimate(c) -> Column:
    """Unrounded usage estimate: words * 1.3 (callers floor it per row)."""
    return F.size(tokens(c)) * F.lit(1.3)


def camel_space(c) -> Column:
    """A blank before every capital letter except at the first character."""
    return F.regexp_replace(_c(c), r"(?<!^)(?=[A-Z])", " ")


def normalize_url(c) -> Column:
    """Drop the query string, keep everything else (fragment too)."""
    return F.regexp_replace(_c(c), r"^([^?#]*)\?[^#]*", "$1")


def uri_extension(c) -> Column:
    """Lower-cased suffix of the file part before '?', '.bin' when none."""
    path = F.regexp_extract(_c(c), r"^([^?]*)", 1)
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    ext = F.regexp_extract(name, r"^.+?(\.[^.]+)$", 1)
    return F.when(ext == "", F.lit(".bin")).otherwise(F.lower(ext))


def safe_name(c) -> Column:
    """File-safe id: '/', '\\' and ':' become '_'."""
    return F.translate(_c(c), "/\\:", "___")


def entry_name(name, content) -> Column:
    """Entry file name: safe, without blanks, and told apart from others of
    the same name by a stable suffix from the content."""
    safe = F.regexp_replace(safe_name(name), r"\s", "_")
    return F.concat_ws("_", safe, F.substring(F.sha2(_c(content), 256), 1, 12))


def chunk_id(native_id, index) -> Column:
    return F.concat(_c(native_id).cast("string"), F.lit("_chunk_"), _c(index).cast("string"))


# --- fixed values: personal identity number and phone patterns, and the
# --- secret pattern, exactly as the redaction rules define them.
HETU_PATTERNS = (
    r"\b([0-3]{1}[0-9]{1}[0-1]{1}[0-9]{1}[0-9]{2})([-+A]{1})([0-9]{3})([a-zA-Z0-9]{1})\b",
    r"\b([0-3]{1}[0-9]{1}[0-1]{1}[0-9]{1}[0-9]{2})([-+A]{1})",
    r"\b([0-3]{1}[0-9]{1}[0-1]{1}[0-9]{1}[0-9]{2})([-+A]{1})?([a-zA-Z]{3,4})?\b",
    r"\b([0-3]{1}[0-9]{1}[0-1]{1}[0-9]{1}[0-9]{2})([-+A]{1})?([0-9]{3})?([a-zA-Z0-9]{1})?\b",
)
PHONE_PATTERNS = (
    r"\b(\+?[0-9]{11,12})\b",
    r"\b(\+?[0-9]{2,3}\s?[0-9]{2,3}\s?[0-9]{1,3}\s?[0-9]{3}\s?[0-9]{4})\b",
    r"\b([0-9]{2,3}\s?[0-9]{1,3}\s?[0-9]{3,4}\s?[0-9]{3,4})\b",
    r"\b([0-9]{2,3}\s?[0-9]{3,4}\s?[0-9]{3,4})\b",
    r"\b([0-9]{2,3}\s?[0-9]{3,5}\s?[0-9]{3,5})\b",
    r"\b(\(?[0-9]{2,3}\)?\s?[0-9]{5,6}\)?)\b",
)
HETU_TOKEN = "[HETU]"
PHONE_TOKEN = "[PUHELIN]"
SECRET_PATTERN = r"(?i)(api[-_]?key|token|password|secret)[=:]\s*[\w-]+"
SECRET_PARAM_KEYS = ("api-key", "apikey", "api_key", "key", "token", "secret")
# --- end of fixed values


def redact_pii(c, profile: str = "hetu") -> Column:
    """Identity numbers -> [HETU]; profile 'hetu_phone' also phones -> [PUHELIN].

    Patterns run in order, each on the output of the one before.  ``(?U)``
    gives Python's Unicode-aware word boundaries.
    """
    if profile not in ("hetu", "hetu_phone"):
        raise ValueError(f"unknown redaction profile {profile!r}")
    out = _c(c)
    for p in HETU_PATTERNS:
        out = F.regexp_replace(out, "(?U)" + p, HETU_TOKEN.replace("[", "\\[").replace("]", "\\]"))
    if profile == "hetu_phone":
        for p in PHONE_PATTERNS:
            out = F.regexp_replace(out, "(?U)" + p,
                                   PHONE_TOKEN.replace("[", "\\[").replace("]", "\\]"))
    return out


def redact_secrets(c) -> Column:
    """``key=value`` style secrets become ``key=REDACTED`` (any case)."""
    return F.regexp_replace(_c(c), "(?U)" + SECRET_PATTERN, "$1=REDACTED")


def mask_params(m) -> Column:
    """Mask the values of sensitive keys in a map<string,string> to '***'."""
    keys = F.array(*[F.lit(k) for k in SECRET_PARAM_KEYS])
    return F.transform_values(_c(m), lambda k, v: F.when(F.array_contains(keys, F.lower(k)),
                                                          F.lit("***")).otherwise(v))


def markdown_ok(c) -> Column:
    """Markdown quality gate: not blank, no <html / </html>, every character
    printable or whitespace (Python's isprintable/isspace)."""
    t = _c(c)
    blank = t.isNull() | (py_strip(t) == "")
    has_html = t.rlike(r"(?i)<html|</html>")
    # Python isprintable() is False for categories Cc Cf Cs Co Cn Zl Zp Zs (but ' ').
    bad = t.rlike(r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}\p{Zl}\p{Zp}\p{Zs}&&[^ " + PY_WS + "]]")
    return ~blank & ~has_html & ~bad


def metadata_header(title, native_id, classification_title, classification_code,
                    organization_name, date_decision, case_id, section,
                    is_attachment=None, attachment_title=None, attachment_url=None,
                    decision_native_id=None) -> Column:
    """Context header placed before every chunk; a line only for present fields.

    Line texts are fixed values (Finnish labels) of the header format.
    """
    def present(x):
        return x.isNotNull() & (x != "")

    def col_or_null(x):
        return _c(x) if x is not None else F.lit(None).cast("string")

    ti, ni = col_or_null(title), col_or_null(native_id)
    ct, cc = col_or_null(classification_title), col_or_null(classification_code)
    org, dd = col_or_null(organization_name), col_or_null(date_decision)
    cid, sec = col_or_null(case_id), col_or_null(section)
    at, au = col_or_null(attachment_title), col_or_null(attachment_url)
    dni = col_or_null(decision_native_id)
    is_att = _c(is_attachment) if is_attachment is not None else F.lit(False)

    decision_line = (F.when(present(ti) & present(ni),
                            F.concat(F.lit('Päätös: "'), ti, F.lit('" (ID: '), ni, F.lit(")")))
                     .when(present(ti), F.concat(F.lit('Päätös: "'), ti, F.lit('"')))
                     .when(present(ni), F.concat(F.lit("Päätös ID: "), ni)))
    attachment_line = F.when(is_att, F.when(present(at) & present(au),
                                            F.concat(F.lit('Liite: "'), at, F.lit('" ('), au, F.lit(")")))
                             .when(present(at), F.concat(F.lit('Liite: "'), at, F.lit('"')))
                             .when(present(au), F.concat(F.lit("Liite: "), au)))
    parent_line = F.when(is_att & present(dni) & ~F.coalesce(dni == ni, F.lit(False)),
                         F.concat(F.lit("Päätöksen ID: "), dni))
    class_line = (F.when(present(ct) & present(cc),
                         F.concat(F.lit("Luokitus: "), ct, F.lit(" ("), cc, F.lit(")")))
                  .when(present(ct), F.concat(F.lit("Luokitus: "), ct)))
    org_line = F.when(present(org), F.concat(F.lit("Organisaatio: "), org))
    date_line = F.when(present(dd), F.concat(F.lit("Päivämäärä: "), F.split(dd, "T").getItem(0)))
    case_line = F.when(present(cid), F.concat(F.lit("Diaarinumero: "), cid))
    section_line = F.when(present(sec), F.concat(F.lit("Pykälä: "), sec))
    return F.concat_ws("\n", F.lit("--- Dokumentin konteksti ---"), decision_line, attachment_line,
                       parent_line, class_line, org_line, date_line, case_line, section_line,
                       F.lit("---"))
