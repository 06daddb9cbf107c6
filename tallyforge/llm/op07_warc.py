"""Operator 7: WARC derivatives, linked metadata and plain-text conversion records of responses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
#: Elements whose content isn't text (those of one group don't nest), those that break a line, and named characters.
HIDDEN = ("script|style", "noscript|template", "head")
BREAKS = "p|div|br|hr|h[1-6]|li|ul|ol|dl|dt|dd|tr|table|article|section|nav|header|footer|main|aside|blockquote|pre|figure|form|body|html|title"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]
SQUEEZE = [("[ \\t\\r\\f\\x{a0}]+", " "), (" ?\\n[ \\n]*", "\n"), ("^[ \\n]+", ""), ("[ \\n]+$", "")]


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body of x, with x evaluated once."""
    return F.element_at(F.transform(F.array(x), body), 1)


def without(html: Column, closing: str, opening: str, to: str) -> Column:
    """html without what stands between the first opening and the next closing, over and over. The text is split at the closings,
    so that its length alone counts, not how many openings lack one."""
    cut = lambda s: F.regexp_replace(s, opening, to)
    return let(F.split(html, closing, -1), lambda parts: F.concat(F.array_join(F.transform(F.slice(parts, 1, F.size(parts) - 1), cut), ""), F.element_at(parts, -1)))


def before_tag(s: Column) -> Column:
    """A piece of text that ended in '>': what stands before its first '<', and a line break if a tag of BREAKS begins there."""
    at = F.instr(s, "<")
    head = F.substr(s, F.lit(1), at - 1)
    broken = F.rlike(F.substr(s, at), F.lit(f"(?i)^</?(?:{BREAKS})\\b"))
    return F.when(at == 0, F.concat(s, F.lit(">"))).when(broken, F.concat(head, F.lit("\n"))).otherwise(head)


def plain(html: Column) -> Column:
    """Text of a page: without comments, hidden elements and tags, named characters resolved, white space squeezed. Comments and hidden
    elements that nothing closes stay, but for their tags. In time that grows with the length of any text."""
    html = without(html, "-->", "(?s)<!--.*", "")
    for tag in HIDDEN:
        html = without(html, f"(?i)</(?:{tag})\\s*>", f"(?is)<(?:{tag})\\b.*", "\n")
    html = let(F.split(html, ">", -1), lambda parts: F.concat(F.array_join(F.transform(F.slice(parts, 1, F.size(parts) - 1), before_tag), ""), F.element_at(parts, -1)))
    return squeezed(html)


def squeezed(text: Column) -> Column:
    """text with named characters resolved and white space squeezed."""
    for name, to in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(to))
    for pattern, to in SQUEEZE:
        text = F.regexp_replace(text, pattern, to)
    return text


def title_of(html: Column) -> Column:
    """What stands between the first '<title ...>' and the first closing tag of a title (tags have no meaning there); empty without one."""
    inner = lambda parts: let(F.split(parts[0], "(?i)<title", 2), lambda opened: F.when((F.size(parts) == 2) & (F.size(opened) == 2) & (F.instr(F.get(opened, F.lit(1)), ">") > 0), F.substr(F.get(opened, F.lit(1)), F.instr(F.get(opened, F.lit(1)), ">") + 1)).otherwise(""))
    return let(F.split(html, "(?i)</title\\s*>", 2), inner)


def count_links(html: Column) -> Column:
    """Pieces up to a '>' whose first tag is an <a> with a href."""
    link = lambda s: F.rlike(F.substr(s, F.greatest(F.instr(s, "<"), F.lit(1))), F.lit("(?is)^<a\\s+.*href"))
    return let(F.split(html, ">", -1), lambda parts: F.size(F.filter(F.slice(parts, 1, F.size(parts) - 1), link)))


def urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def digest(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(x, 256))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """Response records of crawled pages: (page_id, record_id, target_uri, date, http, payload, block_digest, payload_digest).

    A null html is an empty payload; a null url a record without target. Identifiers come from page_id, url and
    payload, so that equal rows have equal ones. Row-wise; an empty table gives no rows.
    """
    page = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("target_uri"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"))
    page = page.select("page_id", "target_uri", F.lit(date).alias("date"), http.alias("http"), "payload", digest(F.col("payload")).alias("payload_digest"))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return page.select("page_id", urn(F.lit("response"), blank("page_id"), blank("target_uri"), F.col("payload_digest")).alias("record_id"), "target_uri", "date", "http", "payload", digest(F.concat("http", "payload")).alias("block_digest"), "payload_digest")


def read_responses(records: DataFrame, record_col: str = "record", id_col: str = "page_id") -> DataFrame:
    """Response records as responses() gives them, read from whole WARC records (text of header, block and end, one a row).

    The record's own identifier, target, date and digests are kept, and the HTTP header lines as they were sent; a digest that the
    record lacks is computed. The block is as many bytes as Content-Length says. Rows of other types (request, warcinfo),
    null ones and those without a WARC header are left out. An HTTP message without a blank line is all header. An
    empty table gives no rows; other columns are ignored.
    """
    given = records.select(F.col(id_col).alias("page_id"), F.col(record_col).cast("string").alias("r")).where(F.col("r").startswith("WARC/") & (F.instr("r", "\r\n\r\n") > 0))
    head = F.substring_index("r", "\r\n\r\n", 1)
    field = lambda name: F.nullif(F.regexp_extract("head", f"(?im)^{name}:[ \\t]*([^\r\n]*)", 1), F.lit(""))
    body = F.encode(F.substr("r", F.length("head") + 5), "UTF-8")
    parsed = given.select("page_id", "r", head.alias("head")).where(F.lower(field("WARC-Type")) == "response")
    block = F.when(field("Content-Length").isNull(), body).otherwise(F.substring(body, F.lit(1), F.try_to_number(field("Content-Length"), F.lit("999999999999")).cast("int")))
    parsed = parsed.select("page_id", "head", F.decode(block, "UTF-8").alias("block"))
    http = F.when(F.instr("block", "\r\n\r\n") > 0, F.concat(F.substring_index("block", "\r\n\r\n", 1), F.lit("\r\n\r\n"))).otherwise(F.col("block"))
    parsed = parsed.withColumn("http", http).withColumn("payload", F.substr("block", F.length("http") + 1))
    return parsed.select(
        "page_id", field("WARC-Record-ID").alias("record_id"), field("WARC-Target-URI").alias("target_uri"), F.coalesce(field("WARC-Date"), F.lit(DATE)).alias("date"), "http", "payload",
        F.coalesce(field("WARC-Block-Digest"), digest(F.col("block"))).alias("block_digest"), F.coalesce(field("WARC-Payload-Digest"), digest(F.col("payload"))).alias("payload_digest"),
    )


def derivatives(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response: (page_id, record_type, record_id, refers_to, linked_to,
    target_uri, content_type, content_length, block_digest, source_digest, record), two rows per response.

    Both refer to the response (WARC-Refers-To, with its target and date) and to each other
    (WARC-Concurrent-To). The metadata's fields keep the response's HTTP header lines, both its digests, its
    length, its title and the number of links; the conversion is the page's plain text. record is the whole
    record as written to a file. One pass without a shuffle.

    A null target leaves out the target header. An empty payload has an empty conversion. Repeated rows give equal
    records, once each. An empty table gives no rows. Columns other than those of responses() are
    ignored, whatever their names.
    """
    base = records.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", "http", "payload", F.col("block_digest").alias("source_block_digest"), F.col("payload_digest").alias("source_digest"))
    title, links = title_of(F.col("payload")), count_links(F.col("payload"))
    headers = F.regexp_replace(F.regexp_replace("http", "\\r\\n\\r\\n$", ""), "(?m)^", "source-header: ")
    fields = F.concat(
        headers, F.lit("\r\nsource-block-digest: "), "source_block_digest", F.lit("\r\nsource-payload-digest: "), "source_digest",
        F.lit("\r\nsource-payload-length: "), F.octet_length("payload").cast("string"), F.lit("\r\ntitle: "), F.regexp_replace(squeezed(title), "\\n", " "), F.lit("\r\noutlinks: "), links.cast("string"), F.lit("\r\n"),
    )
    ids = base.withColumns({"meta_id": urn(F.lit("metadata"), F.col("refers_to")), "text_id": urn(F.lit("conversion"), F.col("refers_to"))})
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.col("meta_id").alias("record_id"), F.col("text_id").alias("linked_to"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.col("text_id").alias("record_id"), F.col("meta_id").alias("linked_to"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain(F.col("payload")).alias("block")),
    )
    both = ids.select("page_id", "refers_to", "target_uri", "date", "source_digest", F.explode(kinds).alias("x")).select("page_id", "refers_to", "target_uri", "date", "source_digest", "x.*")
    both = both.withColumns({"content_length": F.octet_length("block").cast("bigint"), "block_digest": digest(F.col("block"))})
    target = lambda name: F.coalesce(F.concat(F.lit(f"{name}: "), F.col("target_uri"), F.lit("\r\n")), F.lit(""))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), "record_type", F.lit("\r\nWARC-Record-ID: "), "record_id", F.lit("\r\nWARC-Date: "), "date", F.lit("\r\n"), target("WARC-Target-URI"),
        F.lit("WARC-Refers-To: "), "refers_to", F.lit("\r\n"), target("WARC-Refers-To-Target-URI"), F.lit("WARC-Refers-To-Date: "), "date", F.lit("\r\nWARC-Concurrent-To: "), "linked_to",
        F.lit("\r\nWARC-Block-Digest: "), "block_digest", F.lit("\r\nContent-Type: "), "content_type", F.lit("\r\nContent-Length: "), F.col("content_length").cast("string"), F.lit("\r\n\r\n"), "block", F.lit("\r\n\r\n"),
    )
    return both.select("page_id", "record_type", "record_id", "refers_to", "linked_to", "target_uri", "content_type", "content_length", "block_digest", "source_digest", record.alias("record"))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    char = lambda s: quote(s).replace("\n", "' || chr(10) || '")

    last = lambda x, pattern, change: f"list_transform([{x}], lambda x: array_to_string(list_transform(regexp_split_to_array(x, {quote(pattern)}), lambda s, i: case when i < len(regexp_split_to_array(x, {quote(pattern)})) then {change} else s end), ''))[1]"

    def clean(x: str) -> str:
        x = last(x, "-->", "regexp_replace(s, '(?s)<!--.*', '')")
        for tag in HIDDEN:
            x = last(x, f"(?i)</(?:{tag})\\s*>", f"regexp_replace(s, '(?is)<(?:{tag})\\b.*', chr(10))")
        x = last(x, ">", f"case when instr(s, '<') = 0 then s || '>' when regexp_matches(substr(s, instr(s, '<')), '(?i)^</?(?:{BREAKS})\\b') then substr(s, 1, instr(s, '<') - 1) || chr(10) else substr(s, 1, instr(s, '<') - 1) end")
        return squeeze(x)

    def squeeze(x: str) -> str:
        for name, to in ENTITIES:
            x = f"replace({x}, {quote(name)}, {quote(to)})"
        for p, to in SQUEEZE:
            x = f"regexp_replace({x}, {quote(p)}, {char(to)}, 'g')"
        return x

    title = "list_transform([regexp_split_to_array(payload, '(?i)</title\\s*>')], lambda p: case when len(p) > 1 and regexp_matches(p[1], '(?i)<title') then list_transform([substr(p[1], len(regexp_split_to_array(p[1], '(?i)<title')[1]) + 7)], lambda r: case when instr(r, '>') > 0 then substr(r, instr(r, '>') + 1) else '' end)[1] else '' end)[1]"
    links = "len(list_filter(string_split(payload, '>')[:-2], lambda s: regexp_matches(substr(s, greatest(instr(s, '<'), 1)), '(?is)^<a\\s+.*href')))"
    nl = "chr(13) || chr(10)"
    uuid = lambda x: f"'<urn:uuid:' || substr(md5({x}), 1, 8) || '-' || substr(md5({x}), 9, 4) || '-' || substr(md5({x}), 13, 4) || '-' || substr(md5({x}), 17, 4) || '-' || substr(md5({x}), 21, 12) || '>'"
    target = lambda name: f"coalesce('{name}: ' || target_uri || {nl}, '')"
    return f"""with page as (select page_id, url target_uri, coalesce(html, '') payload, 'sha256:' || sha256(coalesce(html, '')) source_digest,
 'HTTP/1.1 200 OK' || {nl} || 'Content-Type: text/html; charset=utf-8' || {nl} || 'Content-Length: ' || strlen(coalesce(html, '')) || {nl} || {nl} http from pages),
named as (select *, {uuid("concat('response|', page_id, '|', target_uri, '|', source_digest)")} refers_to, 'sha256:' || sha256(http || payload) source_block_digest from page),
ids as (select *, {uuid("'metadata|' || refers_to")} meta_id, {uuid("'conversion|' || refers_to")} text_id from named),
both_ as (select page_id, refers_to, target_uri, source_digest, 'metadata' record_type, meta_id record_id, text_id linked_to, 'application/warc-fields' content_type,
 'source-header: HTTP/1.1 200 OK' || {nl} || 'source-header: Content-Type: text/html; charset=utf-8' || {nl} || 'source-header: Content-Length: ' || strlen(payload) || {nl} || 'source-block-digest: ' || source_block_digest || {nl}
 || 'source-payload-digest: ' || source_digest || {nl} || 'source-payload-length: ' || strlen(payload) || {nl} || 'title: ' || regexp_replace({squeeze(title)}, '\\n', ' ', 'g') || {nl}
 || 'outlinks: ' || {links} || {nl} block from ids
 union all select page_id, refers_to, target_uri, source_digest, 'conversion', text_id, meta_id, 'text/plain; charset=utf-8', {clean('payload')} from ids),
done as (select *, strlen(block)::bigint content_length, 'sha256:' || sha256(block) block_digest from both_)
select page_id, record_type, record_id, refers_to, linked_to, target_uri, content_type, content_length, block_digest, source_digest,
 'WARC/1.1' || {nl} || 'WARC-Type: ' || record_type || {nl} || 'WARC-Record-ID: ' || record_id || {nl} || 'WARC-Date: {DATE}' || {nl} || {target('WARC-Target-URI')} || 'WARC-Refers-To: ' || refers_to || {nl} || {target('WARC-Refers-To-Target-URI')}
 || 'WARC-Refers-To-Date: {DATE}' || {nl} || 'WARC-Concurrent-To: ' || linked_to || {nl} || 'WARC-Block-Digest: ' || block_digest || {nl} || 'Content-Type: ' || content_type || {nl} || 'Content-Length: ' || content_length || {nl} || {nl} || block || {nl} || {nl} record from done"""


ORACLE = _sql()
