"""Case tables: inputs made from the rules, with the results the link policy must give."""

from hrefloom.functions import rules

H = "https://tea.example"

UNRESERVED = "AZaz09-._~"
RESERVED = "/?#[]@!$&'()*+,;="

CANONICAL = (
    [(u, u) for u in ("http://tea.example/menu", f"{H}/menu?cup=2&pot=1", f"{H}/Menu/TODAY", f"{H}:8081/menu", f"{H}:80/x", "http://tea.example:443/x")]
    + [
        (f"{H}/menu?cup=2#steep", f"{H}/menu?cup=2"),
        (f"{H}///pots////clay///", f"{H}/pots/clay"),
        (f"{H}//", H),
        (f"{H}:443//pots/", f"{H}/pots"),
        ("http://tea.example:80", "http://tea.example"),
        (f"{H}.:443/menu", f"{H}/menu"),
        (f"{H}/p?pot=1&cup=9&cup=10&ash=", f"{H}/p?ash=&cup=10&cup=9&pot=1"),
        (f"{H}/%e8%8c%B6/%C3%89t%c3%a9", f"{H}/%E8%8C%B6/%C3%89t%C3%A9"),
        (f"{H}/leaf?size=3&gclid=1&kind=oolong#x", f"{H}/leaf?kind=oolong&size=3"),
    ]
    + [(f"{H}/x%{ord(c):02x}y", f"{H}/x{c}y") for c in UNRESERVED]
    + [(f"{H}/x%{ord(c):02x}y", f"{H}/x%{ord(c):02X}y") for c in RESERVED]
    + [(f"{H}/p?{k}=v&cup=2", f"{H}/p?cup=2") for k in rules.TRACKING_KEYS]
    + [(f"{H}/p?{k}", f"{H}/p") for k in rules.TRACKING_KEYS]
    + [(f"{H}/p?{k.upper()}=v", f"{H}/p?{k.upper()}=v") for k in rules.TRACKING_KEYS]
)

# pinned decisions
CANONICAL_MORE = [
    ("HTTPS://TEA.Example/Page", f"{H}/Page"),
    ("https://u:p@tea.example./p", "https://u:p@tea.example/p"),
    (f"{H}/a/../b/./c", f"{H}/a/../b/./c"),
    (f"{H}/p?", f"{H}/p"),
    (f"{H}/p?&&a=1&", f"{H}/p?a=1"),
    (f"{H}/p?b&a=&a", f"{H}/p?a=&a&b"),
    (f"{H}/p?q=a+b&r=%41", f"{H}/p?q=a%20b&r=A"),
    (f"{H}/p?u=https://x.example/?y", f"{H}/p?u=https%3A//x.example/?y"),
    (f"{H}:0443/p", f"{H}/p"),
    (f"{H}:{'0' * 40}443/p", f"{H}/p"),
    (f"{H}:2147483647/p", f"{H}:2147483647/p"),
    (f"{H}:2147483648/p", None),
    (f"{H}:99999999999/p", None),
    (f"{H}:/p", f"{H}/p"),
    (f"{H}/%2525", f"{H}/%2525"),
    (f"{H}/p?a=2&a=10&a=1", f"{H}/p?a=1&a=10&a=2"),
    ("http://[::1]:80/x", "http://[::1]/x"),
    ("http://two words/", None),
    (f"{H}/th\u00e9", None),
    (f"{H}/%zz", None),
    ("http://h:tcp/", None),
    (f"{H}/a#b#c", None),
]

ACCEPT = (
    [(f"{H}{p}", True) for p in ("", "/", "/menu", "/menu.html", "/menu.php?x=1", "/w/index.php?title=Tea", "/wiki/Green_tea", "/wiki/a/b:c", "//wiki/Help:Tea")]
    + [(u, False) for u in ("/menu", "mailto:host@tea.example", "ftp://tea.example/leaf", "http:///x", "//tea.example/x", "two words", "")]
    + [(f"{H}/leaf.{e}", False) for e in rules.ASSET_EXTENSIONS]
    + [(f"{H}/leaf.{e.upper()}?v=2", False) for e in rules.ASSET_EXTENSIONS]
    + [(f"{H}/{e}", True) for e in rules.ASSET_EXTENSIONS]
    + [(f"{H}/leaf.{e}/more", True) for e in rules.ASSET_EXTENSIONS]
    + [(f"{H}/w/index.php?title=Tea&{k}=1", False) for k in rules.WIKI_ACTION_KEYS]
    + [(f"{H}/any?{k}", False) for k in rules.WIKI_ACTION_KEYS]
    + [(f"{H}/any?%{ord(k[0]):02x}{k[1:]}=1", False) for k in rules.WIKI_ACTION_KEYS]
    + [(f"{H}/any?{k.upper()}=1", True) for k in rules.WIKI_ACTION_KEYS]
    + [(f"{H}/any?x{k}=1", True) for k in rules.WIKI_ACTION_KEYS]
    + [(f"{H}/wiki/{n}:Tea", False) for n in ("Help", "Category", "Benutzer", "%E8%8C%B6", "")]
)

_DOMAINS = [d for d in rules.blocked_domain_set() if "/" not in d]

BLOCKED = (
    [(f"https://{d}/x", True) for d in _DOMAINS]
    + [(f"http://sub.of.{d}?q=1", True) for d in _DOMAINS]
    + [(f"https://{d.upper()}./x", True) for d in _DOMAINS]
    + [(f"https://not{d}/x", False) for d in _DOMAINS if d.count(".") == 1]
    + [(f"https://{d}.tea.example/x", False) for d in _DOMAINS]
    + [(f"https://{x}.{d}/x", True) for d in rules.BLOCKED_LABELS for x in ("tea", "a.b")]
    + [(f"https://www.{d}.example/x", True) for d in rules.BLOCKED_LABELS]
    + [(f"https://{d}ernor.example/x", False) for d in rules.BLOCKED_LABELS]
    + [(f"http://tea.{d}/x", True) for d in rules.BLOCKED_FINAL_LABELS]
    + [(f"http://{d}.tea.example/x", False) for d in rules.BLOCKED_FINAL_LABELS]
    + [
        ("https://microsoft.com/store", False), ("https://co.uk/x", False), ("/relative", False), ("mailto:a@wikipedia.org", False),
        ("https://wikipedia.org..evil.example/", False), (f"{H}/github.com", False),
    ]
)
