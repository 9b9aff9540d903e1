"""Operator 7: license scan by ordered signature rules.

Rules are regexes over the lower-cased text, signatures written by hand and families of names and versions, gated by a keyword that an Aho-Corasick pass must have met.
They are ordered by priority; an interval that lies inside one of a rule of higher or equal priority is
suppressed, so "version 3 of the GNU Affero General Public License" does not also count as another GPL.
Base phrases are reported beside the rules and never suppressed.

Words are runs of 0-9, a-z and anything beyond ASCII after A-Z became a-z.

Cases: a null or empty text has no words and no labels; equal rows get equal results; other columns pass.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

WORD, GAP, SOME = r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]", r"[\x00-\x2f\x3a-\x60\x7b-\x7f]++", r"[\x00-\x2f\x3a-\x60\x7b-\x7f]*+"  # possessive: never tried again
#: Base phrases and labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Families (label, names, versions, whether "or later" is told apart).
FAMILIES: list[tuple[str, list[str], list[str], bool]] = [
    ("agpl", ["gnu affero general public license", "affero general public license", "agpl"], ["1.0", "3.0"], True),
    ("lgpl", ["gnu lesser general public license", "gnu library general public license", "lesser general public license", "lgpl"], ["2.0", "2.1", "3.0"], True),
    ("gpl", ["gnu general public license", "gnu public license", "gnu gpl", "gpl"], ["1.0", "2.0", "3.0"], True),
    ("gfdl", ["gnu free documentation license", "gfdl"], ["1.1", "1.2", "1.3"], True),
    ("apache", ["apache software license", "apache license", "apache"], ["1.0", "1.1", "2.0"], False),
    ("mpl", ["mozilla public license", "mpl"], ["1.0", "1.1", "2.0"], False),
    ("epl", ["eclipse public license", "epl"], ["1.0", "2.0"], False),
    ("cddl", ["common development and distribution license", "cddl"], ["1.0", "1.1"], False),
    ("cpl", ["common public license"], ["1.0"], False),
    ("eupl", ["european union public licence", "european union public license", "eupl"], ["1.0", "1.1", "1.2"], False),
    ("osl", ["open software license"], ["1.0", "2.0", "2.1", "3.0"], False),
    ("afl", ["academic free license"], ["1.1", "1.2", "2.0", "2.1", "3.0"], False),
    ("artistic", ["artistic license"], ["1.0", "2.0"], False),
    ("php", ["php license"], ["3.0", "3.01"], False),
    ("zpl", ["zope public license"], ["1.1", "2.0", "2.1"], False),
    ("python", ["python license", "psf license"], ["2.0", "3.0"], False),
    ("boost", ["boost software license"], ["1.0"], False),
    ("ofl", ["sil open font license", "open font license"], ["1.0", "1.1"], False),
    ("lppl", ["latex project public license", "lppl"], ["1.0", "1.1", "1.2", "1.3", "1.3a", "1.3c"], False),
    ("ms-pl", ["microsoft public license"], [], False),
    ("ms-rl", ["microsoft reciprocal license"], [], False),
    ("odbl", ["open database license", "odbl"], ["1.0"], False),
    ("pddl", ["public domain dedication and license"], ["1.0"], False),
    ("cecill", ["cecill free software license", "cecill"], ["1.0", "1.1", "2.0", "2.1"], False),
    ("rpl", ["reciprocal public license"], ["1.1", "1.5"], False),
    ("upl", ["universal permissive license"], ["1.0"], False),
    ("bsl", ["business source license"], ["1.0", "1.1"], False),
    ("sspl", ["server side public license"], ["1.0"], False),
    ("elastic", ["elastic license"], ["1.0", "2.0"], False),
    ("ncsa", ["university of illinois ncsa open source license"], [], False),
    ("qpl", ["q public license"], ["1.0"], False),
    ("w3c", ["w3c software notice and license", "w3c software and document license"], [], False),
]
#: Creative Commons elements and versions.
CC = {"by-nc-nd": "attribution noncommercial noderivatives", "by-nc-sa": "attribution noncommercial sharealike", "by-nc": "attribution noncommercial", "by-nd": "attribution noderivatives", "by-sa": "attribution sharealike", "by": "attribution"}
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
#: Single phrases (label, phrase), in order of priority.
PHRASES: list[tuple[str, str]] = [
    ("cc0", "cc0"), ("cc0", "creative commons zero"), ("mit", "mit license"), ("mit", "released under the mit"), ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit-0", "mit no attribution"), ("isc", "isc license"), ("isc", "permission to use copy modify and or distribute this software for any purpose"), ("bsd-2-clause", "bsd 2 clause"), ("bsd-2-clause", "simplified bsd license"),
    ("bsd-3-clause", "bsd 3 clause"), ("bsd-3-clause", "new bsd license"), ("bsd-3-clause", "modified bsd license"), ("bsd-4-clause", "bsd 4 clause"), ("bsd-4-clause", "original bsd license"),
    ("bsd-0-clause", "zero clause bsd"), ("bsd", "redistribution and use in source and binary forms"), ("bsd", "bsd license"), ("unlicense", "this is free and unencumbered software released into the public domain"), ("unlicense", "the unlicense"),
    ("wtfpl", "do what the fuck you want to public license"), ("wtfpl", "wtfpl"), ("zlib", "zlib license"), ("zlib", "this software is provided as is without any express or implied warranty"), ("libpng", "libpng license"),
    ("x11", "x11 license"), ("ijg", "independent jpeg group s software"), ("openssl", "openssl license"), ("curl", "curl license"), ("beerware", "beer ware license"),
    ("public-domain", "released into the public domain"), ("public-domain", "this work is in the public domain"), ("public-domain", "dedicated to the public domain"), ("proprietary", "proprietary and confidential"), ("proprietary", "unauthorized copying of this file"),
    ("copyright", "copyright c"), ("copyright", "copyright notice"), ("no-license", "no license is granted"), ("commercial", "commercial license"), ("eula", "end user license agreement"),
]
#: Signatures written by hand (label, keyword, regex; a space is any run of other characters), after names with versions and before bare names.
SIGNATURES: list[tuple[str, str, str]] = [
    ("mit", "noninfringement", r"merchantability fitness for a particular purpose and noninfringement in no event shall the authors"),
    ("mit", "sublicense", r"(?:the rights )?to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", "substantial", r"(?:the )?above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", "mit", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?mit"),
    ("mit", "mit", r"mit style licen[sc]e"), ("mit", "expat", r"expat licen[sc]e"), ("mit", "opensource", r"opensource org licenses? mit"),
    ("isc", "isc", r"(?:licensed|released|distributed) under (?:the )?isc"), ("isc", "opensource", r"opensource org licenses? isc"),
    ("isc", "consortium", r"internet systems consortium"), ("0bsd", "0bsd", r"0bsd"),
    ("bsd-3-clause", "endorse", r"neither the names? of .{1,200}? may be used to endorse or promote products"),
    ("bsd-3-clause", "endorse", r"may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd-2-clause", "binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-2-clause", "freebsd", r"(?:the )?freebsd licen[sc]e"), ("bsd", "bsd", r"bsd style licen[sc]e"), ("bsd", "bsd", r"(?:licensed|released|distributed) under (?:the |a )?bsd"),
    ("bsd-3-clause", "opensource", r"opensource org licenses? bsd 3 clause"), ("bsd-2-clause", "opensource", r"opensource org licenses? bsd 2 clause"),
    ("bsd-patent", "bsd", r"bsd 2 clause plus patent|bsd 2 clause patent"), ("bsd-1-clause", "bsd", r"bsd 1 clause"),
    ("apache-2.0", "apache", r"licensed under the apache licen[sc]e version 2(?: 0)?"), ("apache-2.0", "apache", r"(?:www )?apache org licenses license 2 0"),
    ("apache-2.0", "apache", r"terms and conditions of the apache licen[sc]e"), ("apache-2.0", "contributor", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("apache-1.1", "apache", r"this product includes software developed by the apache software foundation"), ("apache", "asl", r"asl 2(?: 0)?"),
    ("gpl-3.0", "gpl", r"gplv3|gpl v 3|gpl3"), ("gpl-2.0", "gpl", r"gplv2|gpl v 2|gpl2"), ("gpl-3.0-or-later", "gpl", r"gplv3 or later|gpl 3 0 or later"), ("gpl-2.0-or-later", "gpl", r"gplv2 or later|gpl 2 0 or later"),
    ("lgpl-3.0", "lgpl", r"lgplv3|lgpl v 3"), ("lgpl-2.1", "lgpl", r"lgplv2 1|lgpl v 2 1"), ("lgpl-2.0", "lgpl", r"lgplv2"), ("agpl-3.0", "agpl", r"agplv3|agpl v 3"),
    ("gpl", "gnu", r"(?:www )?gnu org (?:licenses|copyleft) gpl"), ("lgpl", "gnu", r"(?:www )?gnu org (?:licenses|copyleft) lgpl"), ("agpl", "gnu", r"(?:www )?gnu org licenses agpl"), ("gfdl", "gnu", r"(?:www )?gnu org (?:licenses|copyleft) fdl"),
    ("gpl", "redistribute", r"this program is free software you can redistribute it and or modify it"), ("lgpl", "redistribute", r"this library is free software you can redistribute it and or modify it"),
    ("gpl", "warranty", r"this program is distributed in the hope that it will be useful but without any warranty"), ("lgpl", "warranty", r"this library is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "gnu", r"you should have received a copy of the gnu general public licen[sc]e"), ("lgpl", "gnu", r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e"), ("agpl", "gnu", r"you should have received a copy of the gnu affero general public licen[sc]e"),
    ("gpl", "franklin", r"free software foundation inc 51 franklin"), ("gpl", "temple", r"free software foundation inc 59 temple place"), ("gpl", "copyleft", r"copyleft licen[sc]e"),
    ("gpl-classpath", "classpath", r"classpath exception"), ("gpl-linking", "special", r"as a special exception .{1,120}? permission to link"), ("gfdl", "invariant", r"with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2.0", "mpl", r"mozilla org mpl 2 0"), ("mpl-1.1", "mpl", r"mozilla org mpl mpl 1 1|mplv1 1"), ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0"),
    ("mpl-1.1", "mozilla", r"contents of this file are subject to the mozilla public licen[sc]e version 1 1"), ("epl-1.0", "eclipse", r"eclipse org legal epl v10"), ("epl-2.0", "eclipse", r"eclipse org legal epl 2 0|eclipse org legal epl v20"),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[sc]e (?:v(?: )?)?1 0"), ("cddl-1.0", "cddl", r"opensource org licenses? cddl1?"), ("cpl-1.0", "common", r"common public licen[sc]e v 1 0"), ("eupl-1.2", "eupl", r"eupl (?:v(?: )?)?1 2"),
    ("cc0", "publicdomain", r"creativecommons org publicdomain zero 1 0"), ("cc0", "cc0", r"cc0 1 0(?: universal)?"), ("cc0", "waived", r"has waived all copyright and related or neighboring rights"), ("cc-pd-mark", "publicdomain", r"creativecommons org publicdomain mark 1 0"),
    ("cc-by", "creative", r"creative commons attribution(?: licen[sc]e)?"), ("cc-by-sa", "creative", r"creative commons share(?: )?alike"), ("cc-by-nc", "creative", r"creative commons non(?: )?commercial"), ("cc", "creative", r"(?:some rights reserved )?under a creative commons licen[sc]e"),
    ("cc-by-sa", "alike", r"attribution share alike"), ("cc-by-nc-sa", "alike", r"attribution non(?: )?commercial share(?: )?alike"), ("cc-by-nc-nd", "deriv", r"attribution non(?: )?commercial no(?: )?deriv(?:ative)?s?"), ("cc-by-nd", "deriv", r"attribution no(?: )?deriv(?:ative)?s?"), ("cc-sampling", "sampling", r"creative commons sampling(?: plus)?"),
    ("boost-1.0", "boost", r"boost org license 1 0|distributed under the boost software licen[sc]e"), ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"), ("zlib", "altered", r"altered source versions must be plainly marked as such"),
    ("unlicense", "unlicense", r"unlicense org"), ("wtfpl", "wtfpl", r"wtfpl net"), ("wtfpl", "what", r"you just do what the f\S{1,4} you want to"), ("beerware", "beer", r"you can buy me a beer in return"), ("postcardware", "postcardware", r"postcardware"),
    ("artistic", "artistic", r"(?:clarified|perl) artistic licen[sc]e"), ("artistic", "perl", r"same terms as perl(?: itself)?"), ("ruby", "ruby", r"same terms as ruby|ruby licen[sc]e"), ("python-2.0", "python", r"python software foundation licen[sc]e(?: version 2)?"), ("php", "php", r"php net license"),
    ("vim", "vim", r"vim licen[sc]e"), ("tcl", "tcl", r"tcl tk licen[sc]e"), ("icu", "icu", r"icu licen[sc]e"), ("unicode", "unicode", r"unicode (?:inc )?licen[sc]e agreement|unicode org copyright"), ("json", "evil", r"shall be used for good not evil"), ("postgresql", "postgresql", r"postgresql licen[sc]e"),
    ("curl", "curl", r"curl mit x derivate|curl haxx se docs copyright"), ("ntp", "ntp", r"ntp licen[sc]e"), ("libtiff", "libtiff", r"libtiff licen[sc]e"), ("imagemagick", "imagemagick", r"imagemagick licen[sc]e"), ("freetype", "freetype", r"freetype (?:project )?licen[sc]e"), ("ofl-1.1", "scripts", r"scripts sil org ofl"), ("ofl-1.1", "openfontlicense", r"openfontlicense org"),
    ("odbl-1.0", "odbl", r"opendatacommons org licenses odbl"), ("odc-by-1.0", "opendatacommons", r"opendatacommons org licenses by"), ("odc-by-1.0", "commons", r"open data commons attribution licen[sc]e"), ("pddl-1.0", "pddl", r"opendatacommons org licenses pddl"), ("ogl-uk-3.0", "government", r"open government licen[sc]e(?: v3 0)?"), ("etalab-2.0", "etalab", r"etalab"), ("etalab-2.0", "ouverte", r"licence ouverte"),
    ("sspl-1.0", "sspl", r"sspl"), ("elastic-2.0", "elastic", r"elastic licen[sc]e 2 0"), ("elastic-2.0", "elv2", r"elv2"), ("bsl-1.1", "change", r"change date .{1,80}? change licen[sc]e"), ("commons-clause", "clause", r"commons clause licen[sc]e condition"), ("polyform", "polyform", r"polyform (?:noncommercial|small business|strict|shield|perimeter)"),
    ("openrail", "rail", r"(?:bigscience |creativeml )?open(?: )?rail(?: m)?"), ("llama", "llama", r"llama(?: \d)?(?: \d)? community licen[sc]e"), ("gemma", "gemma", r"gemma terms of use"), ("research-only", "research", r"(?:for )?non(?: )?commercial research (?:use|purposes) only"), ("research-only", "academic", r"academic use only"),
    ("proprietary", "confidential", r"(?:strictly )?confidential and proprietary"), ("proprietary", "trade", r"trade secrets? of"), ("proprietary", "permission", r"without (?:the )?(?:prior |express )*(?:written )?permission of the (?:copyright )?(?:owner|author|publisher)"), ("proprietary", "reproduced", r"no part of this (?:publication|book|work|document) may be reproduced"), ("proprietary", "reverse", r"you may not reverse engineer decompile or disassemble"), ("proprietary", "redistribution", r"redistribution (?:is )?(?:strictly )?prohibited"), ("proprietary", "transmitted", r"reproduced distributed or transmitted in any form or by any means"),
    ("public-domain", "domain", r"(?:placed|put|dedicated|released|is) in(?:to)? the public domain"), ("public-domain", "disclaims", r"author (?:hereby )?disclaims copyright to this source code"), ("us-government", "government", r"work of the (?:u s|united states) government"), ("copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d"), ("copyright", "copyrighted", r"copyrighted material|is copyrighted by"),
    ("terms", "terms", r"terms of (?:use|service)|terms and conditions of use"), ("attribution", "attribution", r"attribution required"), ("attribution", "credit", r"please credit the author"), ("fair-use", "fair", r"fair use (?:act|doctrine|notice)"), ("dmca", "dmca", r"dmca"), ("dmca", "millennium", r"digital millennium copyright act"),
]


def _phrase(text: str) -> str:
    return GAP.join(re.escape(w) for w in text.split())


def _version(v: str) -> str:
    short = re.escape(v[:-2]) + r"(?:\.0)?" if v.endswith(".0") else re.escape(v)
    return rf"{SOME}(?:(?:version|licen[sc]e|v){SOME})?(?:v\.?)?{short}(?!\.?[0-9])"


def _rules() -> list[tuple[str, str, str]]:
    """(label, keyword, regex), in order of priority: longer and more exact signatures first."""
    out: list[tuple[str, str, str]] = []
    for label, names, versions, later in FAMILIES:
        for v in versions:
            for name in names:
                key = max(name.split(), key=len)
                if later:
                    out.append((f"{label}-{v}-or-later", key, _phrase(name) + _version(v) + GAP + r"or" + GAP + r"(?:at" + GAP + r"your" + GAP + r"option" + GAP + r")?(?:any" + GAP + r")?(?:later|newer)"))
                out.append((f"{label}-{v}", key, _phrase(name) + _version(v)))
            for tag in {f"{label}-{v}", f"{label}-{v}-only", f"{label}-{v}-or-later"} if later else {f"{label}-{v}"}:
                out.append((tag.removesuffix("-only"), "spdx", rf"spdx-license-identifier:\s*{re.escape(tag)}"))
    for element, words in CC.items():
        for v in CC_VERSIONS:
            tag = element.replace("-", GAP)
            out.append((f"cc-{element}-{v}", "cc", rf"cc{GAP}{tag}{GAP}{re.escape(v)}(?!\.?[0-9])"))
            out.append((f"cc-{element}-{v}", "creativecommons", rf"creativecommons\.org/licenses/{re.escape(element)}/{re.escape(v)}"))
            out.append((f"cc-{element}-{v}", "creative", rf"creative{GAP}commons{GAP}{_phrase(words)}{_version(v)}"))
        out.append((f"cc-{element}", "cc", rf"cc{GAP}{element.replace('-', GAP)}"))
        out.append((f"cc-{element}", "creative", rf"creative{GAP}commons{GAP}{_phrase(words)}"))
    out += [(label, key, pattern.replace(" ", GAP)) for label, key, pattern in SIGNATURES]
    for label, names, _, _ in FAMILIES:
        for name in names:
            if " " in name:
                out.append((label, max(name.split(), key=len), _phrase(name)))
    out += [(label, max(phrase.split(), key=len), _phrase(phrase)) for label, phrase in PHRASES]
    return out


RULES = _rules()
_compiled: tuple[ahocorasick.Automaton, list[re.Pattern], dict[str, re.Pattern]] | None = None


def compiled() -> tuple[ahocorasick.Automaton, list[re.Pattern], dict[str, re.Pattern]]:
    global _compiled
    if _compiled is None:
        gate, of = ahocorasick.Automaton(), {}
        for i, (_, key, _) in enumerate(RULES):
            of.setdefault(key, []).append(i)
        for key, rules in of.items():
            gate.add_word(key, rules)
        gate.make_automaton()
        whole = lambda p: re.compile(rf"(?<!{WORD})(?:{p})(?!{WORD})")
        _compiled = gate, [whole(p) for _, _, p in RULES], {p: whole(_phrase(p)) for p in BASE}
    return _compiled


def ascii_lower(text: str) -> str:
    """A-Z alone, so that positions stay."""
    return text.encode("utf-8").lower().decode("utf-8")


_word = re.compile(WORD + "+")


def uncontained(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (start, end, rule) those that lie inside none of a rule of higher priority, that is of a smaller number.

    Intervals are taken by start, and longer ones first; a Fenwick tree over the rules holds the largest end so far of each
    prefix of them. A suppressed interval's suppressor contains whatever it contains, so that none needs to be left out."""
    size = len(RULES) + 1
    most = [-1] * (size + 1)
    kept = []
    for a, b, rule in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        i, best = rule, -1  # rules 0 .. rule - 1
        while i > 0:
            best = max(best, most[i])
            i -= i & -i
        if best < b:
            kept.append((a, b, rule))
        i = rule + 1
        while i <= size:
            most[i] = max(most[i], b)
            i += i & -i
    return kept


def scan(text: str) -> tuple[list[tuple[int, str]], list[tuple[int, int, str]]]:
    """Of a lower-cased text: base places (first character, label) and what the rules found (start, end, label)."""
    gate, rules, base = compiled()
    places = sorted((m.start(), BASE[p]) for p, r in base.items() if p.split()[0] in text for m in r.finditer(text))
    met: set[int] = set()
    for _, ids in gate.iter(text):
        met.update(ids)
    found = [(m.start(), m.end(), i) for i in met for m in rules[i].finditer(text)]
    return places, sorted((a, b, RULES[i][0]) for a, b, i in uncontained(found))


def licenses(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns, counts, labels, a score, and the detections (start, end, label) in characters."""

    def fn(col: pa.Array) -> dict[str, pa.Array]:
        data, offsets = common.utf8(col)
        _, _, first = common.word_spans(data, offsets, common.ALNUM)
        rows = []
        for t in col.to_pylist():
            low = ascii_lower(t or "")
            places, found = scan(low)
            starts = [p for p, _ in places]
            at = (len(_word.findall(low[: starts[0]])), len(_word.findall(low[: starts[-1]]))) if starts else (None, None)
            own = sorted({x for _, x in places})
            rows.append((len(starts), *at, ",".join(own), ",".join(sorted({*own, *(x for _, _, x in found)})), min(1.0, 0.5 * bool(places) + 0.25 * len({x for _, _, x in found})), found))
        flat = list(zip(*rows)) if rows else [[] for _ in range(7)]
        return {
            "n_words": pa.array(np.diff(first), pa.int64()), "n_base": pa.array(flat[0], pa.int64()), "first_word": pa.array(flat[1], pa.int64()), "last_word": pa.array(flat[2], pa.int64()),
            "base_labels": pa.array(flat[3], pa.string()), "labels": pa.array(flat[4], pa.string()), "score": pa.array(flat[5], pa.float64()),
            "detections": pa.array([[{"start": a, "end": b, "label": x} for a, b, x in f] for f in flat[6]], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))),
        }

    return common.map_appending(
        df, keep, text,
        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start: int, end: int, label: string>>",
        fn,
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(common.table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"]).drop("detections")
