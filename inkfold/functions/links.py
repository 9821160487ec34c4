"""URL rules as columns: RFC 3986 parts, game and video links, labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grammar of an absolute URI, a fixed pattern: scheme, authority (user info, host, port), path, query, fragment.
_PCT = "%[0-9A-Fa-f]{2}"
_UNRESERVED = "[A-Za-z0-9._~-]"
_SUB = "[!$&'()*+,;=]"
_PCHAR = f"(?:{_UNRESERVED}|{_PCT}|{_SUB}|[:@])"
_HOST = rf"(?:\[[0-9A-Fa-f:.]+\]|\[v[0-9A-Fa-f]+\.[A-Za-z0-9._~!$&'()*+,;=:-]+\]|(?:{_UNRESERVED}|{_PCT}|{_SUB})*)"
_AUTHORITY = f"(?:((?:{_UNRESERVED}|{_PCT}|{_SUB}|:)*)@)?({_HOST})(?::([0-9]*))?"
_PATHS = f"(?://{_AUTHORITY}((?:/{_PCHAR}*)*)|(/(?:{_PCHAR}+(?:/{_PCHAR}*)*)?|{_PCHAR}+(?:/{_PCHAR}*)*|))"
URI = rf"^([A-Za-z][A-Za-z0-9+.-]*):{_PATHS}(?:\?((?:{_PCHAR}|[/?])*))?(#(?:{_PCHAR}|[/?])*)?$"
_AUTHORITY_MARK = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


@dataclass(frozen=True)
class GameRule:
    """Which https links are games: host, path and the fragment's beginning; label of a game's place."""

    host: str
    path: str
    prefix: str
    place: str


VIDEO_SHORT_HOST = "youtu.be"
VIDEO_HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com")


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, URI, group)


def is_uri(url: Column) -> Column:
    return F.coalesce(url.rlike(URI), F.lit(False))


def lookup_query(query: Column, key: str) -> Column:
    """The value of the first pair with that key, undecoded; null if there's none or it's empty."""
    pairs = F.filter(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1) == key)
    first = F.try_element_at(pairs, F.lit(1))
    return F.nullif(F.when(F.contains(first, F.lit("=")), F.substr(first, F.instr(first, "=") + 1)).otherwise(""), F.lit(""))


def video_id(url: Column) -> Column:
    host = F.lower(_part(url, 3))
    path, query = _part(url, 5), F.regexp_replace(_part(url, 7), r"^\?+", "")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    first, second = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    found = F.when(host == VIDEO_SHORT_HOST, first).when(
        host.isin(*VIDEO_HOSTS),
        F.when((F.size(parts) == 1) & (first == "watch"), lookup_query(query, "v")).when((F.size(parts) >= 2) & first.isin("shorts", "embed"), second),
    )
    return F.when(found.rlike("^[A-Za-z0-9_-]{11}$"), found)


def is_game(url: Column, rule: GameRule) -> Column:
    authority = F.regexp_extract(url, _AUTHORITY_MARK, 1)  # neither user info nor port, not even empty ones
    fragment = _part(url, 8)
    prefix = "#" + rule.prefix
    return (
        F.coalesce(url.startswith("https:"), F.lit(False))
        & (F.lower(authority) == rule.host)
        & (_part(url, 5) == rule.path)
        & fragment.startswith(prefix)
        & (F.length(fragment) > len(prefix))
    )


def link_error(url: Column) -> Column:
    scheme = _part(url, 1)
    return F.when(~is_uri(url), F.concat(F.lit("invalid URI: "), url)).when(~scheme.isin("http", "https"), F.concat(F.lit("unsupported URI scheme: "), url))


def classify(url: Column, rule: GameRule) -> Column:
    """(kind, video_id, url, error): game, video or external; kind is null where there's an error."""
    video, error = video_id(url), link_error(url)
    kind = F.when(error.isNull(), F.when(is_game(url, rule), "game").when(video.isNotNull(), "video").otherwise("external"))
    return F.struct(kind.alias("kind"), F.when(kind == "video", video).alias("video_id"), F.when(kind.isin("game", "external"), url).alias("url"), error.alias("error"))


def game_label(url: Column, rule: GameRule) -> Column:
    """`Play <route> in <place>`; a route whose escapes aren't UTF-8 stays as it is."""
    route = F.substr(_part(url, 8), F.lit(len(rule.prefix) + 2))
    decoded = F.try_url_decode(F.replace(route, F.lit("+"), F.lit("%2B")))
    failed = decoded.isNull() | (F.contains(decoded, F.lit("�")) & ~F.contains(F.upper(route), F.lit("%EF%BF%BD")))
    return F.concat(F.lit("Play "), F.replace(F.when(failed, route).otherwise(decoded), F.lit("-"), F.lit(" ")), F.lit(f" in {rule.place}"))


def embed_url(video: Column) -> Column:
    return F.concat(F.lit("https://www.youtube-nocookie.com/embed/"), F.url_encode(video), F.lit("?autoplay=1"))
