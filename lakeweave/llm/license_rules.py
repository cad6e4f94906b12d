"""The rules of the license scan: written by hand as families, each family giving a rule per license.

A rule works on the words of a text, lower-cased and joined by single spaces. It has a label, a priority and a regex; its
keywords are read off the regex: clauses of literals, of each of which one occurs in every match.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    regex: str


# License label, words of its name, words of its SPDX identifier.
NAMES = (
    ("mit", "mit", "mit"),
    ("mit", "expat", "expat"),
    ("mit-0", "mit no attribution", "mit 0"),
    ("x11", "x11", "x11"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib(?: libpng)?", "zlib"),
    ("apache-1.1", "apache(?: software)? 1 1", "apache 1 1"),
    ("apache-2", "apache(?: software)? 2(?: 0)?", "apache 2 0"),
    ("bsd-2-clause", "(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd)", "bsd 2 clause"),
    ("bsd-3-clause", "(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd)", "bsd 3 clause"),
    ("bsd-4-clause", "(?:original bsd|bsd 4 clause|4 clause bsd)", "bsd 4 clause"),
    ("0bsd", "(?:zero clause bsd|0bsd)", "0bsd"),
    ("gpl-2", "(?:gnu )?gpl ?v?2(?: 0)?", "gpl 2 0"),
    ("gpl-3", "(?:gnu )?gpl ?v?3(?: 0)?", "gpl 3 0"),
    ("lgpl-2.1", "(?:gnu )?lgpl ?v?2 1", "lgpl 2 1"),
    ("lgpl-3", "(?:gnu )?lgpl ?v?3(?: 0)?", "lgpl 3 0"),
    ("agpl-3", "(?:gnu )?agpl ?v?3(?: 0)?", "agpl 3 0"),
    ("gfdl-1.3", "gnu free documentation", "gfdl 1 3"),
    ("mpl-1.1", "mozilla public 1 1", "mpl 1 1"),
    ("mpl-2", "mozilla public(?: 2(?: 0)?)?", "mpl 2 0"),
    ("epl-1", "eclipse public(?: 1 0)?", "epl 1 0"),
    ("epl-2", "eclipse public 2(?: 0)?", "epl 2 0"),
    ("cddl-1", "common development and distribution", "cddl 1 0"),
    ("cpl-1", "common public", "cpl 1 0"),
    ("eupl-1.2", "european union public", "eupl 1 2"),
    ("artistic-1", "artistic 1(?: 0)?", "artistic 1 0"),
    ("artistic-2", "artistic(?: 2(?: 0)?)?", "artistic 2 0"),
    ("bsl-1", "boost software", "bsl 1 0"),
    ("busl-1.1", "business source", "busl 1 1"),
    ("psf-2", "python software foundation", "psf 2 0"),
    ("ruby", "ruby", "ruby"),
    ("php-3", "php", "php 3 01"),
    ("postgresql", "postgresql", "postgresql"),
    ("openssl", "openssl", "openssl"),
    ("ofl-1.1", "(?:sil )?open font", "ofl 1 1"),
    ("odbl-1", "open database", "odbl 1 0"),
    ("odc-by-1", "open data commons attribution", "odc by 1 0"),
    ("pddl-1", "public domain dedication and", "pddl 1 0"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "(?:wtfpl|do what the fuck you want to public)", "wtfpl"),
    ("ms-pl", "microsoft public", "ms pl"),
    ("ms-rl", "microsoft reciprocal", "ms rl"),
    ("upl-1", "universal permissive", "upl 1 0"),
    ("ncsa", "university of illinois(?: ncsa)?(?: open source)?", "ncsa"),
    ("afl-3", "academic free", "afl 3 0"),
    ("osl-3", "open software", "osl 3 0"),
    ("cecill-2.1", "cecill", "cecill 2 1"),
    ("sspl-1", "server side public", "sspl 1 0"),
    ("elastic-2", "elastic", "elastic 2 0"),
    ("vim", "vim", "vim"),
    ("curl", "curl", "curl"),
    ("llama", "llama(?: [0-9]+)?(?: community)?", "llama"),
    ("rail", "(?:open ?)?rail(?: m)?", "rail"),
)
#: Words a license's name and number may be parted by.
_VERSION = r"(?:(?: software)?(?: licen[cs]e)?(?: version| v)?)"
# Label and regex of long forms and notices.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("gpl-2", "gnu general public licen[cs]e(?: gpl)?(?: as published by the free software foundation)?(?: either)?(?: version| v)? 2"),
    ("gpl-3", "gnu general public licen[cs]e(?: gpl)?(?: as published by the free software foundation)?(?: either)?(?: version| v)? 3"),
    ("gpl", "gnu general public licen[cs]e"),
    ("lgpl-2.1", "gnu (?:lesser|library) general public licen[cs]e(?: version| v)? 2(?: 1)?"),
    ("lgpl-3", "gnu (?:lesser|library) general public licen[cs]e(?: version| v)? 3"),
    ("lgpl", "gnu (?:lesser|library) general public licen[cs]e"),
    ("agpl-3", "gnu affero general public licen[cs]e(?:(?: version| v)? 3)?"),
    ("apache-2", "apache licen[cs]e(?: version| v)? 2(?: 0)?"),
    ("apache-2", "www apache org licenses license 2 0"),
    ("cc0-1", "(?:creative commons (?:cc0|zero)|cc0)(?: 1 0)?(?: universal)?"),
    ("public-domain", "(?:released in(?:to)?|dedicated to|in) the public domain"),
    ("all-rights-reserved", "copyright .{1,80}? all rights reserved"),
    ("proprietary", "(?:proprietary|commercial|end user) licen[cs]e(?: agreement)?"),
    ("eula", "end user licen[cs]e agreement"),
)
# Creative Commons variants.
CC = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
CC_LONG = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s"}

# Base phrases and labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


def _close(regex: str, at: int) -> int:
    """The place after the bracket that closes the one there."""
    depth = 0
    for i in range(at, len(regex)):
        depth += (regex[i] == "(") - (regex[i] == ")")
        if not depth:
            return i + 1
    raise ValueError(regex)


def _branches(regex: str) -> list[str]:
    out, depth = [""], 0
    for c in regex:
        depth += (c == "(") - (c == ")")
        out = [*out, ""] if c == "|" and not depth else [*out[:-1], out[-1] + c]
    return out


def needed(regex: str) -> list[tuple[str, ...]]:
    """Clauses of literals; in every match each clause has a literal that occurs. For the constructs that the rules use."""
    clauses: list[tuple[str, ...]] = []
    literal, i = "", 0

    def end() -> None:
        nonlocal literal
        if len(literal) > 2:
            clauses.append((literal,))
        literal = ""

    while i < len(regex):
        group = regex[i] == "("
        stop = _close(regex, i) if group else regex.index("]", i) + 1 if regex[i] == "[" else i + 1
        atom, after = regex[i:stop], regex[stop : stop + 1]
        quantified = after in ("?", "*", "+", "{") and after != ""
        optional = after in ("?", "*") or regex[stop : stop + 2] == "{0"
        if quantified:
            stop = regex.index("}", stop) + 1 if after == "{" else stop + 1
            stop += regex[stop : stop + 1] == "?"
        if not group and not quantified and atom[0] not in "[.":
            literal += atom
        else:
            end()
            if group and not optional:
                inner = [needed(x) for x in _branches(atom.removeprefix("(?:")[:-1])]
                if all(inner):
                    clauses.append(tuple(dict.fromkeys(max((c[0] for c in x if len(c) == 1), key=len, default=x[0][0]) for x in inner)))
        i = stop
    end()
    return clauses


def gate(made: list[Rule]) -> str:
    """A regex that some place of every text that any rule matches fits: of each rule the clause with the longest literals,
    but 'licen' where that will do. Literals that can only stand at a word's start are tried there only."""
    start, inside = set(), set()
    for rule in made:
        clauses = [c for c in needed(rule.regex) if c != (" under ",) and "released" not in c]  # these are common words
        if any(" licen" in f" {c[0]}" for c in clauses if len(c) == 1):
            start.add("licen")
            continue
        for literal in max(clauses, key=lambda c: min(map(len, c))):
            word = literal.lstrip(" ")
            (inside if f" ?)?{word}" in rule.regex else start).add(word)  # after an optional space a word may have begun before
    start = {x for x in start if not any(x != y and x.startswith(y) for y in start)}
    by: dict[str, list[str]] = {}
    for x in sorted(start):
        by.setdefault(x[0], []).append(x[1:])
    heads = "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items())
    return "|".join([f" (?:{heads})", *sorted(inside)])


def rules() -> list[Rule]:
    out = []
    for label, name, spdx in NAMES:
        under = f"(?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?{name}"
        plain = "|" not in name and "?" not in name
        out.append(Rule(label, 4, f"spdx license identifier {spdx}(?: only| or later)?"))
        out.append(Rule(label, 3, f"{under} licen[cs]e" if plain and "licen" not in name else f"{under}(?: licen[cs]e)?"))
        out.append(Rule(label, 2, f"{name}{'' if 'licen' in name else ' licen[cs]e'}"))
        out.append(Rule(label, 2, f"licen[cs]ed? {name}"))
        out.append(Rule(label, 4, f"opensource org licenses {spdx.replace(' 0', '(?: 0)?')}"))
        if name.endswith("public"):
            out.append(Rule(label, 3, f"{name}{_VERSION} {spdx.split(' ', 1)[1]}" if " " in spdx and "licen" in name else f"{name} licen[cs]e(?: version| v)? [0-9]+"))
    out += [Rule(label, 4, regex) for label, regex in NOTICES]
    for kind in CC:
        label, long = f"cc-{kind.replace(' ', '-')}", " ".join(CC_LONG[x] for x in kind.split())
        out.append(Rule(label, 3, f"cc {kind}"))
        out.append(Rule(label, 4, f"cc {kind} [1-4](?: [0-9])?"))
        out.append(Rule(label, 4, f"creative commons {long}(?: (?:international|[1-4](?: 0)?|licen[cs]e))*"))
        out.append(Rule(label, 4, f"creativecommons org licenses {kind}"))
    return out
