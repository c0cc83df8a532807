"""Which files are read, by which loader, and which addresses may be fetched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions by loader.
LOADERS = {
    "markdown": ("md", "markdown", "mdown", "mkd"),
    "pdf": ("pdf",),
    "docx": ("docx",),
    "html": ("html", "htm"),
    "jupyter": ("ipynb",),
    "json": ("json", "jsonl"),
    "csv": ("csv",),
    "code": ("py", "js", "ts", "jsx", "tsx", "java", "cpp", "c", "h", "hpp", "rs", "go", "rb", "php", "swift", "kt", "scala", "cs", "sh", "bash", "zsh", "sql", "r", "m", "lua", "pl"),
    "text": ("txt", "log", "cfg", "ini", "yaml", "yml", "toml", "rst", "org"),
}
# Languages by extension.
LANGUAGES = {
    "python": ("py",),
    "javascript": ("js", "jsx"),
    "typescript": ("ts", "tsx"),
    "java": ("java",),
    "cpp": ("cpp", "hpp"),
    "c": ("c", "h"),
    "rust": ("rs",),
    "go": ("go",),
    "ruby": ("rb",),
    "php": ("php",),
    "swift": ("swift",),
    "kotlin": ("kt",),
    "scala": ("scala",),
    "csharp": ("cs",),
    "bash": ("sh", "bash", "zsh"),
    "sql": ("sql",),
    "r": ("r",),
    "matlab": ("m",),
    "lua": ("lua",),
    "perl": ("pl",),
}
#: Path components below which nothing is read.
IGNORED = ("__pycache__", ".git", ".svn", "node_modules", ".venv", "venv", "env", ".env", ".cache", ".corpusmill")
# IPv4 networks that are never fetched, as first address and prefix length.
BLOCKED = (
    ("0.0.0.0", 8),
    ("10.0.0.0", 8),
    ("100.64.0.0", 10),
    ("127.0.0.0", 8),
    ("169.254.0.0", 16),
    ("172.16.0.0", 12),
    ("192.0.0.0", 24),
    ("192.0.2.0", 24),
    ("192.168.0.0", 16),
    ("198.18.0.0", 15),
    ("198.51.100.0", 24),
    ("203.0.113.0", 24),
    ("224.0.0.0", 4),
    ("240.0.0.0", 4),
    ("255.255.255.255", 32),
)
# IPv6 networks that are never fetched.
BLOCKED_V6 = ("::1/128", "fc00::/7", "fe80::/10", "ff00::/8")
MAX_FILE_BYTES = 200 * 1024 * 1024


def extension(path: Column) -> Column:
    """Lower-cased extension of the file name, without the dot; "" for none."""
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"^.+\.([^.]*)$", 1))


def _lookup(table: dict[str, tuple[str, ...]], ext: Column, otherwise: Column) -> Column:
    out = otherwise
    for name, extensions in table.items():
        out = F.when(ext.isin(list(extensions)), name).otherwise(out)
    return out


def loader(path: Column) -> Column:
    """The loader's name; "unknown" for extensions that must be sniffed."""
    return _lookup(LOADERS, extension(path), F.lit("unknown"))


def language(path: Column) -> Column:
    return _lookup(LANGUAGES, extension(path), F.lit("unknown"))


def source_type(path: Column) -> Column:
    kind = loader(path)
    return F.when(kind.isin("markdown", "pdf"), kind).when(kind.isin("code", "jupyter"), "code").otherwise("text")


def ignored(path: Column, components: tuple[str, ...] = IGNORED) -> Column:
    """Whether a component of the path, not a part of one, is on the list."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(c) for c in components]))


def scanned(path: Column) -> Column:
    """Whether a folder scan takes the file: not ignored and of a known extension."""
    return ~ignored(path) & (loader(path) != "unknown")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]*\]|[^/?#:]*)", 1))


def url_allowed(url: Column) -> Column:
    """http or https with a host that is no literal address of a blocked network.

    Names are resolved, and each redirect checked again, where pages are fetched.
    """
    name = host(url)
    octets = F.split(name, r"\.")
    part = lambda i: F.try_to_number(F.get(octets, i), F.lit("999")).cast("bigint")
    number = F.when(F.regexp_like(name, F.lit(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")), part(0) * 16_777_216 + part(1) * 65_536 + part(2) * 256 + part(3))
    blocked = F.lit(False)
    for first, length in BLOCKED:
        low = 0
        for octet in first.split("."):
            low = low * 256 + int(octet)
        blocked = blocked | number.between(low, low + (1 << (32 - length)) - 1)
    v6 = F.regexp_like(name, F.lit(r"^\[(::1|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{2}:.*)\]$"))
    return F.coalesce(F.regexp_like(url, F.lit("(?i)^https?://")) & (name != "") & ~F.coalesce(blocked, F.lit(False)) & ~v6, F.lit(False))


def address_blocked(address: str) -> bool:
    """Whether a resolved address lies in a blocked network."""
    from ipaddress import ip_address, ip_network

    ip = ip_address(address)
    networks = [f"{a}/{n}" for a, n in BLOCKED] if ip.version == 4 else BLOCKED_V6
    return any(ip in ip_network(n) for n in networks)
