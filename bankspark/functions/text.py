"""Text functions: what built-in expressions can say is a Column; the rest are plain functions with Arrow-batched UDFs."""

from __future__ import annotations

import email.header
import email.policy
import email.utils
import hashlib
import html.parser
import re
import unicodedata
from email import message_from_string

import pandas as pd
from pyspark.sql import Column, functions as F

#: Characters that are not shown (soft hyphen, joiners, marks of direction, variation selectors, ...).
IGNORABLE = "\\u00ad\\u034f\\u061c\\u115f\\u1160\\u17b4\\u17b5\\u180b-\\u180f\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u206f\\u3164\\ufe00-\\ufe0f\\ufeff\\uffa0\\ufff0-\\ufff8"
IGNORABLE_RE = re.compile(f"[{IGNORABLE}]")


# --- columns -----------------------------------------------------------------------------------------------


def line_endings(c: Column) -> Column:
    """CR LF, CR and Unicode line and paragraph separators as LF."""
    return F.regexp_replace(c, "\r\n|[\r\u0085  ]", "\n")


def without_ignorable(c: Column) -> Column:
    return F.regexp_replace(c, f"[{IGNORABLE}]", "")


def layout(c: Column) -> Column:
    """Lines trimmed, spaces within them collapsed, runs of blank lines collapsed to one, outer ones dropped."""
    spaces = F.regexp_replace(c, "[\\t\\x0b\\x0c   -   　]+", " ")
    lines = F.regexp_replace(spaces, "(?m)^ | $", "")
    return F.regexp_replace(F.regexp_replace(lines, "\n{3,}", "\n\n"), "^\n+|\n+$", "")


def natural(c: Column) -> Column:
    return layout(without_ignorable(line_endings(c)))


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(natural(c), "\\s+", " "))


# --- parts of a mail's body ---------------------------------------------------------------------------------

#: Headings of an earlier message; names of the fields of its header and how far they reach; devices and
#: programs of closing lines; beginnings of notices; the lines from the end among which signatures and templates open.
HEADINGS = r"(?i)^\s*(?:-{2,}\s*original message\s*-{2,}|(?:-{2,}\s*)?(?:begin\s+)?forwarded message(?::|\s*-{2,})?)\s*$"
FIELDS, FIELD_LINES = ("from", "sent", "date", "to", "cc", "subject"), 10
ATTRIBUTION, QUOTE, RULE = r"(?i)^\s*on\s+.{1,240}\s+wrote:\s*$", r"^\s*>", r"^\s*(?:_{8,}|-{8,})\s*$"
SENT_FROM, OUTLOOK_FOR, MAIL_FOR = ("iphone", "ipad", "android", "mobile device"), ("ios", "android"), ("windows",)
NOTICES = r"confidentiality notice:|this (?:e-?mail|message)(?: and any attachments)? (?:is|may be) confidential"
SIGNATURE_LINES, TEMPLATE_LINES = 16, 30


def _over_lines(body: Column, f) -> Column:
    """f of the lines of a body, which are split once: inside a lambda they are a variable, not an expression to be done again."""
    return F.get(F.transform(F.array(F.split(body, "\n", -1)), f), F.lit(0))


def current_body(body: Column) -> Column:
    """What stands before earlier messages, without quoted lines and attributions, in natural layout.

    An earlier message opens at its heading, or at a rule above a header with a sender, a date and an addressee or subject.
    The body has natural layout already; where nothing is taken out it stays as it is."""
    field = rf"(?:{'|'.join(FIELDS)}):[ \t]*\S[^\n]*(?:\n[ \t][^\n]*)*"
    header = lambda lines, i: F.regexp_extract(F.array_join(F.slice(lines, i + 2, FIELD_LINES), "\n"), rf"(?i)^{field}(?:\n{field})*", 0)
    has = lambda h, *names: h.rlike(rf"(?im)^(?:{'|'.join(names)}):")
    earlier = lambda h: has(h, "from") & has(h, "sent", "date") & has(h, "to", "subject")

    def kept(lines: Column) -> Column:
        opens = F.array_min(F.transform(lines, lambda x, i: F.when(x.rlike(HEADINGS), i).when(x.rlike(RULE), F.when(earlier(header(lines, i)), i))))
        own = F.filter(F.slice(lines, F.lit(1), F.coalesce(opens, F.size(lines))), lambda x: ~x.rlike(QUOTE) & ~x.rlike(ATTRIBUTION))
        return F.when(F.size(own) < F.size(lines), F.array_join(own, "\n"))

    left = _over_lines(body, kept)  # null where all lines stay
    return F.when(left.isNull(), body).otherwise(natural(left))


def core_body(current: Column) -> Column:
    """The current body before its signature (a line `--` with text below, not the first line) or closing template, whichever is first."""
    ends = lambda words: f"(?:{'|'.join(words)})"
    device = rf"(?i)^(?:sent from my {ends(SENT_FROM)}|get outlook for {ends(OUTLOOK_FOR)}|sent from mail for {ends(MAIL_FOR)})\.?$"

    def kept(lines: Column) -> Column:
        signs = lambda x, i: (x == "--") & (i >= F.greatest(F.lit(1), F.size(lines) - SIGNATURE_LINES)) & F.exists(F.slice(lines, i + 2, F.size(lines)), lambda y: y != "")
        closes = lambda x, i: (i >= F.size(lines) - TEMPLATE_LINES) & (x.rlike(device) | x.rlike(f"(?i)^(?:{NOTICES})"))
        first = F.array_min(F.transform(lines, lambda x, i: F.when(signs(x, i) | closes(x, i), i)))
        return F.when(first.isNotNull(), F.array_join(F.slice(lines, F.lit(1), first), "\n"))

    left = _over_lines(current, kept)
    return F.when(left.isNull(), current).otherwise(natural(left))


#: Fixed value: the largest size of each bucket in bytes: none, then from one byte less than 256 on fourfold up to a mebibyte.
SIZE_BOUNDS = (0, *(4**k - 1 for k in range(4, 11)))


def size_bucket(bytes_: Column) -> Column:
    """Labels of sizes in bytes: the first and last size of the bucket; the last bucket is open."""
    lows = [0, *(b + 1 for b in SIZE_BOUNDS)]
    labels = [str(high) if low == high else f"{low}-{high}" for low, high in zip(lows, SIZE_BOUNDS)]
    places = [F.when(bytes_ > b, 1).otherwise(0) for b in SIZE_BOUNDS]
    return F.element_at(F.array(*map(F.lit, [*labels, f"{lows[-1]}+"])), sum(places, F.lit(1)))


def group_size_bucket(n: Column) -> Column:
    return F.when(n <= 1, "1").when(n == 2, "2").when(n <= 4, "3-4").when(n <= 9, "5-9").when(n <= 99, "10-99").otherwise("100+")


def domain_hash(domain: str, *parts: Column) -> Column:
    """SHA-256 over a domain and parts with a null byte between; null if a part is null."""
    return F.sha2(F.concat(F.lit(domain), *[x for p in parts for x in (F.lit("\0"), p)]), 256)


def hash64(c: Column) -> Column:
    """The first 16 hex digits of a hash as an unsigned number."""
    return F.conv(F.substring(c, 1, 16), 16, 10).cast("decimal(20,0)")


def hash_fraction(c: Column) -> Column:
    """A hash as a number in [0, 1), of 52 bits."""
    return F.conv(F.substring(c, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def hash_mod(c: Column, n: int) -> Column:
    """A whole hex number modulo n."""
    digits = F.transform(F.split(c, ""), lambda x: F.conv(x, 16, 10).cast("long"))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda acc, d: F.when(d.isNull(), acc).otherwise((acc * 16 + d) % n))


def message_id(c: Column) -> Column:
    """Without spaces and brackets, in lower case; null if empty."""
    return F.nullif(F.lower(F.regexp_replace(c, r"[\s<>()\[\]]+", "")), F.lit(""))


def message_id_references(c: Column) -> Column:
    """Distinct message ids in angle brackets on Message-ID, In-Reply-To and References lines, sorted."""
    lines = F.regexp_extract_all(c, F.lit(r"(?im)^(?:message-id|in-reply-to|references)\s*:[^\r\n]*(?:\r?\n[ \t]+[^\r\n]*)*"), F.lit(0))
    ids = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(r"<[^<>\s]{1,512}>"), F.lit(0))))
    return F.array_sort(F.array_distinct(F.transform(ids, message_id)))


def addresses(*columns: Column) -> Column:
    """Distinct mail addresses in arrays of header values, in lower case, sorted."""
    none = F.array().cast("array<string>")
    values = F.flatten(F.array(*[F.coalesce(c, none) for c in columns]))
    found = F.flatten(F.transform(F.filter(values, lambda x: x.isNotNull()), lambda x: F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}._%+'-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*"), F.lit(0))))
    return F.array_sort(F.array_distinct(found))


def mailbox_folder(file_name: Column) -> Column:
    """Role of the folder in a mailbox path: inbox, sent, deleted, archive or other; null without a folder."""
    folder = F.lower(F.try_element_at(F.split(F.regexp_replace(file_name, r"\\", "/"), "/"), F.lit(-2)))
    return F.when(folder.rlike("^inbox|_inbox$"), "inbox").when(folder.rlike("sent"), "sent").when(folder.rlike("deleted|trash"), "deleted").when(folder.rlike("all_documents|archive|old_mail|^[0-9]{4}$"), "archive").when(folder.isNotNull(), "other")


def ratio(part: Column, whole: Column) -> Column:
    """Null, not zero, where there is nothing to divide by."""
    return F.try_divide(part, whole)


def redaction_token(template: str, entity: Column, ordinal: Column) -> Column:
    """{entity}, {ENTITY}, {ordinal} and {ordinal:04d} of a template."""
    out = F.lit(template)
    out = F.replace(out, F.lit("{ENTITY}"), F.upper(entity))
    out = F.replace(out, F.lit("{entity}"), entity)
    for width in re.findall(r"\{ordinal:0(\d+)d\}", template):
        out = F.replace(out, F.lit(f"{{ordinal:0{width}d}}"), F.when(F.length(ordinal.cast("string")) < int(width), F.lpad(ordinal.cast("string"), int(width), "0")).otherwise(ordinal.cast("string")))
    return F.replace(out, F.lit("{ordinal}"), ordinal.cast("string"))


#: An id, its most characters, and the hex digits that tell made ids apart.
ID, ID_CHARS, ID_DIGITS = r"^[a-z][a-z0-9_]{0,79}$", 80, 12


def entity_slug(raw: Column) -> Column:
    """An id from any text: the text if it is one, else its runs of letters and digits with one underscore between, and digits of its hash.

    What has no letter or digit is called entity; what does not begin with a letter gets that word in front.
    """
    words = F.regexp_extract_all(F.lower(raw), F.lit("[a-z0-9]+"), F.lit(0))
    named = F.when(F.size(words) == 0, F.array(F.lit("entity"))).when(words[0].rlike("^[0-9]"), F.concat(F.array(F.lit("entity")), words)).otherwise(words)
    head = F.rtrim(F.substring(F.array_join(named, "_"), 1, ID_CHARS - ID_DIGITS - 1), F.lit("_"))
    return F.when(raw.rlike(ID), raw).otherwise(F.concat_ws("_", head, F.left(F.sha2(raw, 256), F.lit(ID_DIGITS))))


#: Words that mark a reply or a forwarded message, before a colon and a count in brackets.
REPLY_MARK = r"\s*(?:fwd?|re)\s*(?:\[\d+\])?\s*:"


def thread(subject: Column) -> Column:
    """A subject without the marks of replies before it, in lower case with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(subject), f"^(?:{REPLY_MARK})+", ""), r"\s+", " "))


# --- plain functions and their UDFs ------------------------------------------------------------------------------


def grouping_text(text: str | None, limit: int = 4) -> str | None:
    """NFKC, case folded, without ignorable characters, white space collapsed; null where that grows beyond `limit` times the text."""
    if text is None:
        return None
    out = " ".join(IGNORABLE_RE.sub("", unicodedata.normalize("NFKC", IGNORABLE_RE.sub("", text))).casefold().split())
    return out if len(out) <= limit * max(len(text), 64) else None


def thread_subject(subject: str | None) -> str | None:
    """The grouping text of a subject from the end of its marks of replies on."""
    text = grouping_text(subject)
    if text is None:
        return None
    marks = re.match(f"(?:{REPLY_MARK})*", text)
    return text[marks.end() :].strip()


def header_text(value: str | None) -> str | None:
    """Encoded words decoded; what cannot be decoded stays."""
    if value is None or "=?" not in value:
        return value
    try:
        return str(email.header.make_header(email.header.decode_header(value)))
    except (ValueError, LookupError, UnicodeError):
        return value


class _Visible(html.parser.HTMLParser):
    BLOCKS = set("p div br li tr table ul ol h1 h2 h3 h4 h5 h6 blockquote pre hr section article header footer td th option".split())
    HIDDEN = set("script style head title template noscript svg".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.HIDDEN:
            self.hidden += 1
        elif not self.hidden:
            if tag in self.BLOCKS:
                self.out.append("\n")
            values = dict(attrs)
            shown = values.get("alt") if tag in ("img", "area") else values.get("value") or values.get("placeholder") if tag in ("input", "button") else None
            if shown:
                self.out.append(f" {shown} ")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in self.HIDDEN:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.BLOCKS and not self.hidden:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(data)


def html_text(text: str | None) -> str | None:
    """What a reader of an HTML page sees; other texts as they are."""
    if text is None or not re.search(r"<\s*(?:html|body|p|div|br|table|span|a|font|td|meta|!doctype)\b", text, re.I):
        return text
    parser = _Visible()
    parser.feed(text)
    parser.close()
    return "".join(parser.out)


def mime_text(text: str | None, depth: int = 8) -> str | None:
    """Text of a MIME message: plain parts, or HTML parts where there are none; other texts as they are."""
    if text is None or not re.match(r"(?:[A-Za-z0-9-]+:[^\n]*\n(?:[ \t][^\n]*\n)*)*?(?:content-type|mime-version)\s*:", text, re.I):
        return text
    message = message_from_string(text, policy=email.policy.default)
    plain, pages, todo = [], [], [(message, 0)]
    while todo:
        part, level = todo.pop(0)
        if part.is_multipart():
            if level < depth:
                todo = [(p, level + 1) for p in part.iter_parts()] + todo
            continue
        if part.get_content_disposition() == "attachment":
            continue
        try:
            content = part.get_content()
        except (LookupError, UnicodeError, KeyError):
            raw = part.get_payload(decode=True) or b""
            content = raw.decode("utf-8", "replace")
        if isinstance(content, str):
            (pages if part.get_content_type() == "text/html" else plain).append(content)
    return "\n".join(plain) if plain else "\n".join(filter(None, map(html_text, pages)))


QUOTED_PRINTABLE = re.compile(r"=(?:[0-9A-F]{2}|\r?\n)")


def quoted_printable(text: str | None) -> str | None:
    """Quoted-printable text decoded where it plainly is such (several escapes and no malformed one)."""
    if text is None or len(QUOTED_PRINTABLE.findall(text)) < 3 or re.search(r"=(?![0-9A-F]{2}|\r?\n)", text):
        return text
    import quopri

    return quopri.decodestring(text.encode("utf-8", "surrogateescape")).decode("utf-8", "replace")


def visible_body(text: str | None) -> str | None:
    """MIME, quoted-printable and HTML undone, then one layout."""
    out = html_text(quoted_printable(mime_text(text)))
    if out is None:
        return None
    out = IGNORABLE_RE.sub("", re.sub("\r\n|[\r\x85  ]", "\n", out))
    lines = [" ".join(x.split()) for x in out.split("\n")]
    return re.sub("\n{3,}", "\n\n", "\n".join(lines)).strip("\n")


def person_name(value: str | None) -> str | None:
    """"Last, First" turned round, NFKC, 2 to 8 words of letters without words of roles; null otherwise."""
    if not value:
        return None
    text = " ".join(unicodedata.normalize("NFKC", value).strip(" \"'").split())
    if text.count(",") == 1:
        text = " ".join(reversed([p.strip() for p in text.split(",")]))
    words = text.split()
    if not 2 <= len(words) <= 8 or any(not re.fullmatch(r"[^\W\d_]+(?:['’.-][^\W\d_]*)*\.?", w) for w in words):
        return None
    return None if {w.casefold().strip(".") for w in words} & ROLES else text


ROLES = {"team", "desk", "office", "support", "admin", "administrator", "info", "help", "helpdesk", "sales", "service", "services", "group", "list", "department", "dept", "company", "corporation", "ops", "dispatch", "noreply", "postmaster"}


def cut_to(c: Column, chars: int, size: int) -> Column:
    """At most so many characters and UTF-8 bytes, cut between characters: of the bytes up to three are left off until they are whole."""
    raw = F.encode(F.substring(c, 1, chars), "UTF-8")
    return F.coalesce(*[F.when(F.is_valid_utf8(F.substring(raw, 1, max(0, size - k)).cast("string")), F.substring(raw, 1, max(0, size - k)).cast("string")) for k in range(4)])


def truncated(text: str | None, chars: int, size: int) -> str | None:
    """At most so many characters and UTF-8 bytes, cut between characters."""
    return None if text is None else text[:chars].encode("utf-8")[:size].decode("utf-8", "ignore")


def _udf(f, kind: str = "string"):
    def batch(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    batch.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, kind)


def udfs() -> dict:
    """Arrow-batched UDFs by name, made when a session is there."""
    return {f.__name__: _udf(f) for f in (grouping_text, thread_subject, header_text, html_text, mime_text, visible_body, person_name)}


def assignment_digest(scope: str, entity: str, value: str) -> str:
    """Opaque key of what a replacement stands for."""
    import json

    return f"{entity}|{scope}|{hashlib.sha256(json.dumps([scope, entity, value], ensure_ascii=False, separators=(',', ':')).encode()).hexdigest()}"
