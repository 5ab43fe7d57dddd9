"""Documentation pages in JSON: Markdown, title, references and sample downloads."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliodor.functions.text import SITE


def _inline(nodes: Any) -> str:
    """Text of inline nodes; kinds that aren't known have none."""
    out = []
    for node in nodes if isinstance(nodes, list) else []:
        if not isinstance(node, dict):
            continue
        kind = node.get("type")
        if kind == "text" and isinstance(node.get("text"), str):
            out.append(node["text"])
        elif kind == "codeVoice" and isinstance(node.get("code"), str):
            out.append(f"`{node['code']}`")
        elif kind == "reference" and isinstance(node.get("identifier"), str):
            out.append(node["identifier"].rpartition("/")[2])
        elif kind in ("emphasis", "strong") and isinstance(node.get("inlineContent"), list):
            mark = "*" if kind == "emphasis" else "**"
            out.append(mark + _inline(node["inlineContent"]) + mark)
    return "".join(out)


def _block(node: Any) -> str:
    """Markdown of a block; '' for blocks that aren't shown, such as ordered lists and asides."""
    if not isinstance(node, dict):
        return ""
    match node.get("type"):
        case "paragraph" if isinstance(node.get("inlineContent"), list):
            return _inline(node["inlineContent"])
        case "heading" if isinstance(node.get("inlineContent"), list):
            level = node.get("level")
            return "#" * (int(level) if isinstance(level, (int, float)) and not isinstance(level, bool) else 2) + " " + _inline(node["inlineContent"])
        case "codeListing":
            code = node["code"] if isinstance(node.get("code"), list) else []
            return f"```{node['syntax'] if isinstance(node.get('syntax'), str) else ''}\n" + "\n".join(map(str, code)) + "\n```"
        case "unorderedList" if isinstance(node.get("items"), list):
            held = [item["content"] for item in node["items"] if isinstance(item, dict) and isinstance(item.get("content"), list)]
            return "\n".join("- " + " ".join(filter(None, map(_block, content))) for content in held)
    return ""


def _section(section: Any) -> str:
    if not isinstance(section, dict):
        return ""
    kind, parts = section.get("kind"), []
    held = section.get(kind) if kind in ("content", "declarations", "parameters") else None
    if not isinstance(held, list):
        return ""
    if kind == "content":
        parts = [text for text in map(_block, held) if text]
    elif kind == "declarations":
        parts.append("\n### Declaration\n")
        for one in held:
            if isinstance(one, dict) and isinstance(one.get("tokens"), list):
                parts.append("```\n" + "".join(str(t.get("text", "")) for t in one["tokens"] if isinstance(t, dict)) + "\n```")
    else:
        parts.append("\n### Parameters\n")
        for one in held:
            if isinstance(one, dict):
                parts.append(f"- **{one['name'] if isinstance(one.get('name'), str) else 'unknown'}**: {_inline(one.get('content'))}")
    return "\n".join(parts)


def _of(page: dict, name: str, kind: type) -> Any:
    """A field of the page or else of its metadata."""
    for holder in (page, page.get("metadata")):
        if isinstance(holder, dict) and isinstance(holder.get(name), kind):
            return holder[name]
    return None


def _listed(sections: Any, titled: bool) -> list[str]:
    out = []
    for section in sections if isinstance(sections, list) else []:
        if isinstance(section, dict):
            if titled and isinstance(section.get("title"), str):
                out.append(f"\n## {section['title']}\n")
            out += [f"- {i}" for i in section.get("identifiers") or [] if isinstance(i, str)] if isinstance(section.get("identifiers"), list) else []
    return out


def to_markdown(page: Any, url: str, title: str | None = None) -> str:
    """The page as Markdown: title, abstract, sections, topics, see-also list and source."""
    if not isinstance(page, (dict, list)):
        return f"# {title or 'Document'}\n\nNo content available."
    page = page if isinstance(page, dict) else {}
    out = [f"# {_of(page, 'title', str) or title or 'Document'}\n"]
    if abstract := _inline(_of(page, "abstract", list)):
        out.append(f"{abstract}\n")
    primary = page.get("primaryContentSections")
    body = [text for text in map(_section, primary if isinstance(primary, list) else []) if text]
    body += _listed(page.get("topicSections"), titled=True)
    if isinstance(page.get("seeAlsoSections"), list):
        body += ["\n## See Also\n", *_listed(page["seeAlsoSections"], titled=False)]
    if body:
        out.append("\n".join(body))
    return "\n".join([*out, f"\n---\nSource: {url}"])


def path_title(path: str) -> str:
    last = path.split("/")[-1] or (path.split("/")[-2] if "/" in path else "")
    out, inside = [], False
    for c in last.replace("-", " "):
        word = c == "_" or c.isascii() and c.isalnum()
        out.append(c.upper() if word and not inside else c)
        inside = word
    return "".join(out)


def references(page: Any, prefix: str = "/documentation/", site: str = SITE) -> list[tuple[str, str]]:
    """(url, title) of all references at any depth, repeats kept. The nesting is walked without recursion."""
    out, open_ = [], [page]
    while open_:
        node = open_.pop()
        if isinstance(node, list):
            open_ += reversed(node)
            continue
        if not isinstance(node, dict):
            continue
        refs = node.get("references")
        for ref in refs if isinstance(refs, list) else refs.values() if isinstance(refs, dict) else []:
            if isinstance(ref, dict) and isinstance(ref.get("url"), str) and ref["url"].startswith(prefix):
                out.append((site + ref["url"], ref.get("title") or path_title(ref["url"])))
        open_ += reversed([v for v in node.values() if isinstance(v, (dict, list))])
    return out


def _parsed(text: str | None) -> Any:
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def json_to_markdown(payload: pd.Series, url: pd.Series, title: pd.Series) -> pd.Series:
    """Markdown of JSON pages; null where the payload isn't JSON, so that a caller can fall back to HTML."""
    out = []
    for p, u, t in zip(payload, url, title):
        page = _parsed(p)
        out.append(None if page is None else to_markdown(page, u, t))
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("url", T.StringType()), T.StructField("title", T.StringType())])))
def json_references(payload: pd.Series) -> pd.Series:
    return pd.Series([[{"url": u, "title": t} for u, t in references(_parsed(p))] for p in payload], dtype=object)


def json_title(payload: Column) -> Column:
    """The title of a JSON page or of its metadata."""
    return F.coalesce(F.get_json_object(payload, "$.title"), F.get_json_object(payload, "$.metadata.title"))


def sample_download(payload: Column, base: str) -> Column:
    """The address of a page's active sample download, else null. A full address stays as it is.

    Active is any value that counts as true: not false, null, zero or an empty text. The identifier has to be a text.
    """
    action = F.from_json(F.get_json_object(payload, "$.sampleCodeDownload.action"), "isActive variant, identifier variant")
    kind, told = F.schema_of_variant(action["isActive"]), F.try_variant_get(action["isActive"], "$", "string")
    number = F.try_variant_get(action["isActive"], "$", "double")
    active = F.when(kind == "VOID", False).when(kind == "BOOLEAN", told == "true").when(kind == "STRING", told != "").when(kind.rlike("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)"), number != 0).otherwise(kind.isNotNull())
    identifier = F.when(F.schema_of_variant(action["identifier"]) == "STRING", F.try_variant_get(action["identifier"], "$", "string"))
    return F.when(F.coalesce(active, F.lit(False)) & identifier.isNotNull(), F.when(identifier.rlike("^https?://"), identifier).otherwise(F.concat(F.lit(base), identifier)))
