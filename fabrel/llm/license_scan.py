"""License detection by ordered signature rules, on DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the base rule: (phrase, label).
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Hand-written signatures: label, priority, keyword, regex over lower-cased words joined by single blanks.
# A keyword is one word that every match of its regex holds; among overlapping detections the lower priority wins.
SIGNATURES = """
agpl-3.0|10|affero|gnu affero general public license(?: as published by the free software foundation)? (?:either )?(?:version|v) ?3
agpl|20|affero|(?:gnu )?affero general public license
agpl|30|agpl|agpl(?: v ?[0-9]| version [0-9]| [0-9])?
agpl-3.0|15|agplv3|agplv3(?: or later)?
lgpl-2.1|10|lesser|gnu lesser general public license(?: as published by the free software foundation)? (?:either )?(?:version|v) ?2 1
lgpl-3.0|10|lesser|gnu lesser general public license(?: as published by the free software foundation)? (?:either )?(?:version|v) ?3
lgpl|20|lesser|(?:gnu )?lesser general public license
lgpl-2.0|20|library|gnu library general public license
lgpl|30|lgpl|(?:gnu )?lgpl(?: v ?[0-9]| version [0-9]| [0-9])?
lgpl-2.1|15|lgplv2|lgplv2(?: 1)?(?: or later)?
lgpl-3.0|15|lgplv3|lgplv3(?: or later)?
gpl-2.0|10|general|gnu general public license(?: as published by the free software foundation)? (?:either )?(?:version|v) ?2
gpl-3.0|10|general|gnu general public license(?: as published by the free software foundation)? (?:either )?(?:version|v) ?3
gpl-1.0|10|general|gnu general public license(?: as published by the free software foundation)? (?:either )?(?:version|v) ?1
gpl|25|general|gnu general public license
gpl|30|gpl|(?:gnu )?gpl(?: v ?[0-9]| version [0-9]| [0-9])?
gpl-2.0|15|gplv2|gplv2(?: or later)?
gpl-3.0|15|gplv3|gplv3(?: or later)?
gpl-cpe|10|classpath|gnu general public license version 2 with (?:the )?classpath exception
gpl|40|copyleft|(?:strong )?copyleft license
fdl|20|documentation|gnu free documentation license(?: version 1 [0-9])?
apache-2.0|10|apache|(?:licensed|released|distributed|available) under the (?:terms of the )?apache license version 2 0
apache-2.0|15|apache|apache license (?:version|v) ?2(?: 0)?
apache-2.0|16|apache|apache (?:software )?license 2 0
apache-1.1|15|apache|apache (?:software )?license (?:version|v) ?1 1
apache-1.0|15|apache|apache (?:software )?license (?:version|v) ?1 0
apache|25|apache|apache (?:software )?license
apache-2.0|16|apache2|apache2(?: license)?
mit|10|mit|(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?mit license
mit|20|mit|(?:the )?mit license
mit|30|expat|(?:the )?expat license
mit|10|hereby|permission is hereby granted free of charge to any person obtaining a copy of this software
mit|12|merchantability|the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit-0|10|mit|mit no attribution(?: license)?
x11|20|x11|(?:the )?x11 license
bsd-3-clause|10|neither|redistributions in binary form must reproduce [a-z0-9 ]{0,200}neither the name of
bsd-2-clause|20|redistribution|redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause|12|bsd|(?:3|three) clause bsd(?: license)?
bsd-2-clause|12|bsd|(?:2|two) clause bsd(?: license)?
bsd-4-clause|12|bsd|(?:4|four) clause bsd(?: license)?
bsd-3-clause|12|bsd|(?:new|modified|revised) bsd(?: license)?
bsd-2-clause|12|bsd|(?:simplified|freebsd) bsd(?: license)?
bsd-4-clause|14|advertising|all advertising materials mentioning features or use of this software must display
0bsd|12|bsd|(?:0|zero) clause bsd(?: license)?
bsd|25|bsd|bsd (?:style )?license
isc|20|isc|(?:the )?isc license
isc|10|fee|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
mpl-2.0|10|mozilla|mozilla public license (?:version|v) ?2(?: 0)?
mpl-2.0|12|mozilla|subject to the terms of the mozilla public license v 2 0
mpl-1.1|10|mozilla|mozilla public license (?:version|v) ?1 1
mpl|25|mozilla|mozilla public license
mpl|30|mpl|mpl [0-9]
epl-1.0|10|eclipse|eclipse public license (?:version|v)? ?1(?: 0)?
epl-2.0|10|eclipse|eclipse public license (?:version|v)? ?2(?: 0)?
epl|25|eclipse|eclipse public license
edl-1.0|20|eclipse|eclipse distribution license
eupl-1.2|10|european|european union public licen[cs]e (?:version|v)? ?1 2
eupl-1.1|10|european|european union public licen[cs]e (?:version|v)? ?1 1
eupl|25|european|european union public licen[cs]e
cddl-1.0|20|cddl|(?:common development and distribution license )?cddl(?: version)? 1 0
cddl|25|development|common development and distribution license
cpl-1.0|20|common|common public license(?: version 1 0)?
ipl-1.0|20|ibm|ibm public license(?: version 1 0)?
artistic-2.0|10|artistic|artistic license (?:version )?2(?: 0)?
artistic-1.0|10|artistic|artistic license (?:version )?1(?: 0)?
artistic|25|artistic|(?:the )?artistic license
perl|20|perl|same terms as perl itself
zlib|20|zlib|zlib(?: libpng)? license
libpng|20|libpng|libpng license
boost-1.0|10|boost|boost software license(?: version)? 1 0
boost|25|boost|boost software license
unlicense|20|unlicense|(?:the )?unlicense
unlicense|10|unencumbered|this is free and unencumbered software released into the public domain
public-domain|30|domain|(?:dedicated to|released into|placed in) the public domain
public-domain|35|domain|no copyright public domain
wtfpl|20|wtfpl|wtfpl
wtfpl|10|fuck|do what the fuck you want to public license
beerware|20|beerware|beerware license
beerware|20|beer|beer ware license
postgresql|20|postgresql|postgresql licen[cs]e
python-2.0|20|python|python software foundation license(?: version 2)?
php-3.01|20|php|php license(?: version 3 01)?
ruby|20|ruby|ruby license
openssl|20|openssl|openssl license
curl|20|curl|curl license
icu|20|icu|icu license
unicode|20|unicode|unicode license(?: agreement)?
w3c|20|w3c|w3c software (?:notice and )?license
afl-3.0|20|academic|academic free license(?: version)?(?: 3 0)?
osl-3.0|20|osl|(?:open software license )?osl(?: version)? 3 0
osl|25|open|open software license
ecl-2.0|20|educational|educational community license(?: version 2 0)?
ncsa|20|ncsa|(?:university of illinois )?ncsa open source license
upl-1.0|20|universal|universal permissive license(?: version 1 0)?
ms-pl|20|microsoft|microsoft public license
ms-rl|20|microsoft|microsoft reciprocal license
bsl-1.1|20|business|business source license(?: 1 1)?
sspl-1.0|20|server|server side public license(?: version 1)?
elastic-2.0|20|elastic|elastic license(?: 2 0)?
commons-clause|20|commons|commons clause(?: license condition)?
polyform|20|polyform|polyform (?:noncommercial|shield|strict|small business) license
hippocratic|20|hippocratic|hippocratic license
json|20|json|json license
json|10|evil|the software shall be used for good not evil
ofl-1.1|10|sil|sil open font license(?: version)? 1 1
ofl|25|font|open font license
odbl-1.0|20|odbl|odbl(?: 1 0)?
odbl|25|database|open database license
odc-by|20|commons|open data commons attribution license
pddl|20|domain|public domain dedication and license
cdla|20|cdla|(?:community data license agreement )?cdla (?:permissive|sharing)
ogl|20|government|open government licen[cs]e(?: v ?[0-9])?
llama|20|llama|llama(?: [0-9]+)? community license
llama|20|llama2|llama2 community license
llama|20|llama3|llama3 community license
openrail|20|openrail|(?:creativeml |bigscience )?openrail(?: m)?
proprietary|40|reserved|all rights reserved
proprietary|30|proprietary|proprietary and confidential
commercial|40|commercial|commercial license(?: agreement)?
gpl-2.0|12|fsf|published by the fsf version 2 of the license
gpl|28|gpl|(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?gpl
gpl|22|warranty|this program comes with absolutely no warranty
gpl|20|redistribute|you can redistribute it and or modify it under the terms of the gnu general public license
lgpl|18|redistribute|you can redistribute it and or modify it under the terms of the gnu lesser general public license
agpl|18|redistribute|you can redistribute it and or modify it under the terms of the gnu affero general public license
gpl|22|fitness|without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
gpl|22|received|you should have received a copy of the gnu general public license
lgpl|20|received|you should have received a copy of the gnu lesser general public license
agpl|20|received|you should have received a copy of the gnu affero general public license
gpl-font-exception|10|font|general public license [a-z0-9 ]{0,60}with (?:the )?font exception
gpl-autoconf|10|autoconf|general public license [a-z0-9 ]{0,60}with (?:the )?autoconf exception
gpl-bison|10|bison|general public license [a-z0-9 ]{0,60}with (?:the )?bison exception
gpl-gcc-exception|10|gcc|gcc runtime library exception
gpl-linking-exception|20|linking|(?:static|dynamic|special) linking exception
fdl-1.1|15|documentation|gnu free documentation license version 1 1
fdl-1.2|15|documentation|gnu free documentation license version 1 2
fdl-1.3|15|documentation|gnu free documentation license version 1 3
fdl|30|gfdl|gfdl(?: 1 [0-9])?
apache-2.0|10|compliance|you may not use this file except in compliance with the license
apache-2.0|12|unless|unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0|18|asf|licensed to the apache software foundation asf under one or more contributor license agreements
apache-1.1|12|endorse|the names apache and apache software foundation must not be used to endorse or promote products
mit|14|sublicense|without limitation the rights to use copy modify merge publish distribute sublicense and or sell
mit|16|substantial|shall be included in all copies or substantial portions of the software
mit-modern|20|mit|mit modern(?: variant)? license
mit-cmu|20|cmu|cmu license
mit-enna|20|enna|enna license
mit-feh|20|feh|feh license
bsd-3-clause|14|endorse|may be used to endorse or promote products derived from this software without specific prior written permission
bsd|22|reproduce|redistributions in binary form must reproduce the above copyright notice
bsd|22|retain|redistributions of source code must retain the above copyright notice
bsd-3-clause-clear|10|clear|(?:3 clause clear bsd|clear bsd|bsd 3 clause clear)(?: license)?
bsd-3-clause-lbnl|15|lbnl|(?:lbnl|lawrence berkeley) bsd(?: variant)? license
bsd-2-clause-patent|12|patent|bsd (?:2 clause )?plus patent(?: license)?
bsd-protection|15|protection|bsd protection license
bsd-source-code|15|attribution|bsd source code attribution
isc|12|isc|(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?isc license
mpl-1.0|10|mozilla|mozilla public license (?:version|v) ?1 0
mpl-2.0|12|mpl|the contents of this file are subject to the mpl
mpl|20|obtain|if a copy of the mpl was not distributed with this file you can obtain one
npl-1.1|20|netscape|netscape public license(?: version 1 1)?
spl-1.0|20|sun|sun public license(?: version 1 0)?
sissl|20|sun|sun industry standards source license
cpal-1.0|20|attribution|common public attribution license(?: version 1 0)?
cecill-2.1|10|cecill|cecill (?:free software license agreement )?(?:version )?2 1
cecill-b|10|cecill|cecill b(?: license)?
cecill-c|10|cecill|cecill c(?: license)?
cecill|25|cecill|cecill(?: license)?
eupl-1.0|10|european|european union public licen[cs]e (?:version|v)? ?1 0
apsl-2.0|15|apple|apple public source license(?: version)? 2 0
apsl|25|apple|apple public source license
intel|20|intel|intel open source license
lppl-1.3c|15|latex|latex project public license(?: version)? 1 3c?
lppl|25|latex|latex project public license
lpl-1.02|20|lucent|lucent public license(?: version 1 02)?
nokia|20|nokia|nokia open source license
motosoto|20|motosoto|motosoto (?:open source )?license
naumen|20|naumen|naumen public license
nasa-1.3|20|nasa|nasa open source agreement(?: version)?(?: 1 3)?
ngpl|20|nethack|nethack general public license
oclc-2.0|20|oclc|oclc research public license(?: 2 0)?
ogtsl|20|group|open group test suite license
oset-2.1|20|oset|oset (?:foundation )?public license(?: version 2 1)?
qpl-1.0|20|q|q public license(?: version 1 0)?
rpl-1.5|20|reciprocal|reciprocal public license(?: version)?(?: 1 5)?
rpsl-1.0|20|realnetworks|realnetworks public source license
rscpl|20|ricoh|ricoh source code public license
simpl-2.0|20|simple|simple public license(?: 2 0)?
sleepycat|20|sleepycat|sleepycat license
tcl|20|tcl|tcl tk license
vsl-1.0|20|vovida|vovida software license(?: 1 0)?
vim|20|vim|vim license
watcom-1.0|20|watcom|sybase open watcom public license
xnet|20|xnet|xnet license
zpl-2.1|15|zope|zope public license(?: version)? 2 1
zpl|25|zope|zope public license
mulan-2.0|20|mulan|mulan (?:permissive software license|psl)(?: v2| version 2)?
blueoak-1.0|20|blue|blue oak model license(?: 1 0 0)?
parity-7.0|20|parity|parity public license(?: 7 0 0)?
prosperity|20|prosperity|prosperity public license
anti-996|20|996|anti 996 license
confluent|20|confluent|confluent community license
redis-sal|20|redis|redis source available license
timescale|20|timescale|timescale license(?: agreement)?
fsl-1.1|20|functional|functional source license(?: 1 1)?
busl|25|bsl|(?:business source license )?bsl 1 1
elastic|22|elv2|elv2(?: license)?
sspl|22|sspl|sspl(?: v1)?
openssl|15|ssleay|(?:original )?ssleay license
info-zip|20|zip|info zip license
bzip2|20|bzip2|bzip2 license
libtiff|20|libtiff|libtiff license
imagemagick|20|imagemagick|imagemagick license
freetype|20|freetype|freetype (?:project )?license
ijg|20|jpeg|independent jpeg group license
sgi-b-2.0|20|sgi|sgi free software license b
gemma|20|gemma|gemma terms of use
falcon|20|falcon|falcon llm license
rail-m|20|responsible|responsible ai license
deepseek|20|deepseek|deepseek (?:model )?license(?: agreement)?
qwen|20|qwen|(?:tongyi )?qwen license agreement
mrl|20|mistral|mistral (?:ai )?research license
cdla-permissive-2.0|12|cdla|cdla permissive 2 0
cdla-permissive-1.0|12|cdla|cdla permissive 1 0
cdla-sharing-1.0|12|cdla|cdla sharing 1 0
c-uda|20|computational|computational use of data agreement
odc-by-1.0|15|commons|open data commons attribution license(?: odc by)? v?1 0
etalab-2.0|20|etalab|(?:licence ouverte|open licence) etalab(?: 2 0)?
dl-de-by-2.0|20|datenlizenz|datenlizenz deutschland namensnennung(?: version)?(?: 2 0)?
ogl-canada|15|canada|open government licen[cs]e canada
gutenberg|20|gutenberg|project gutenberg (?:tm )?license
no-derivatives|45|derivatives|no derivatives (?:may be )?(?:made|allowed|permitted)
non-commercial|45|commercial|for non ?commercial (?:use|purposes) only
research-only|45|research|for (?:academic|research) (?:use|purposes) only
evaluation|45|evaluation|for evaluation purposes only
proprietary|28|confidential|strictly confidential(?: and proprietary)?
proprietary|30|unauthorized|unauthorized (?:copying|reproduction|distribution) of this (?:file|software|document)[a-z0-9 ]{0,40} is (?:strictly )?prohibited
proprietary|35|permission|no part of this (?:publication|document|book) may be reproduced [a-z0-9 ]{0,80}without (?:the )?(?:prior )?written permission
"""

# SPDX identifiers, tagged as `SPDX-License-Identifier: <id>`.
SPDX_IDS = """
0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0
CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0
CDDL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 GFDL-1.3-or-later GPL-2.0-only GPL-2.0-or-later GPL-3.0-only
GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0
MS-PL NCSA ODbL-1.0 OFL-1.1 OSL-3.0 PostgreSQL Python-2.0 Ruby UPL-1.0 Unlicense W3C WTFPL X11 Zlib
"""

#: Terms of the Creative Commons suite; each goes with the versions below.
CC_TERMS = {"by": "attribution", "by sa": "attribution share ?alike", "by nc": "attribution non ?commercial", "by nd": "attribution no ?deriv(?:ative)?s", "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: Detections before one that are asked whether they hold it; hits of a block of running sums.
NEAR, BLOCK = 64, 256

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def signature_rules() -> list[tuple[int, str, int, str, str, float]]:
    """(rule id, label, priority, keyword, regex, score): the written signatures, the tag of each identifier, the suite."""
    rules = []
    for line in SIGNATURES.strip().splitlines():
        label, priority, word, regex = line.split("|", 3)
        rules.append((label, int(priority), word, regex, 0.9 if int(priority) <= 20 else 0.6))
    for name in SPDX_IDS.split():
        words = " ".join("".join(c if c.isalnum() else " " for c in name.lower()).split())
        rules.append((name.lower(), 1, "spdx", f"spdx license identifier {words}", 1.0))
    for short, long in CC_TERMS.items():
        for version in CC_VERSIONS:
            rules.append((f"cc-{short}-{version}".replace(" ", "-"), 5, "cc", f"cc {short} {version}".replace(".", " "), 0.95))
            rules.append((f"cc-{short}-{version}".replace(" ", "-"), 5, "creative", f"creative commons {long} {version}(?: international| unported| generic)?".replace(".", " "), 0.95))
        rules.append((f"cc-{short}".replace(" ", "-"), 22, "cc", f"cc {short}", 0.6))
        rules.append((f"cc-{short}".replace(" ", "-"), 22, "creative", f"creative commons {long}", 0.8))
    rules += [("cc0-1.0", 5, "cc0", "cc0(?: 1 0)?", 0.95), ("cc0-1.0", 5, "creative", "creative commons zero(?: 1 0)?", 0.95), ("creative-commons", 40, "creative", "creative commons", 0.5)]
    return [(i, *r) for i, r in enumerate(sorted(rules, key=lambda r: (r[1], r[0], r[3])))]


def normalised(text: Column) -> Column:
    """Words joined by single blanks, one at either end; only blanks for a text without words."""
    return F.regexp_replace(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), SEPARATORS, " ")


def blanks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def phrase_places(words: Column, phrase: str) -> Column:
    """(n, first, last): places of a phrase in normalised words, null where there is none."""
    pieces = F.split(words, f"(?i) {phrase}(?= )", -1)
    size = len(phrase.split())
    n = F.size(pieces) - 1
    last = blanks(words) - 1 - size - (blanks(F.element_at(pieces, -1)) - 1)
    found = F.struct(n.cast("long").alias("n"), blanks(F.element_at(pieces, 1)).cast("long").alias("first"), last.cast("long").alias("last"))
    return F.when(words.rlike(f"(?i) {phrase} "), found)


def any_of(words: list[str]) -> str:
    """A regex for any of the words that looks at the first letter once."""
    by: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        by.setdefault(w[0], []).append(w[1:])
    return "(?=[" + "".join(by) + "])(?:" + "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in by.items()) + ")"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(sizes: Column) -> Column:
    """(s, e) of hits from the lengths of the gaps before them and their own, in blocks of `BLOCK` hits, so that no long array
    is copied for each hit."""
    none = F.array().cast("array<struct<s:int,e:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = F.coalesce(F.try_element_at(acc, F.lit(-1))["e"], F.lit(0)) + x["gap"]
        return F.array_append(acc, F.struct(start.alias("s"), (start + x["hit"]).alias("e")))

    def placed(local: Column) -> Column:
        """The blocks, each moved behind those before it."""
        ends = F.aggregate(local, F.array(F.lit(0)), lambda acc, b: F.array_append(acc, F.element_at(acc, -1) + F.coalesce(F.try_element_at(b, F.lit(-1))["e"], F.lit(0))))
        at = F.slice(ends, F.lit(1), F.size(local))
        return F.flatten(F.zip_with(local, at, lambda b, o: F.transform(b, lambda x: F.struct((x["s"] + o).alias("s"), (x["e"] + o).alias("e")))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(sizes) / BLOCK).cast("int")), lambda k: F.aggregate(F.slice(sizes, k * BLOCK + 1, F.lit(BLOCK)), none, step))
    return let(blocks, placed)


def detections(words: Column, rules: list[tuple]) -> Column:
    """Array of (start, shorter, priority, rule_id, end, label, score) in that order, for normalised words: every match of a
    rule whose keyword the words hold, as an interval of characters; shorter is the length below zero."""
    table = F.array(*[F.struct(F.lit(r[0]).alias("rule_id"), F.lit(r[1]).alias("label"), F.lit(r[2]).alias("priority"), F.lit(r[3]).alias("keyword"), F.lit(f"(?i) (?:{r[4]})(?= )").alias("regex"), F.lit(r[5]).alias("score")) for r in rules])
    held = F.array_intersect(F.split(F.lower(words), " "), F.array(*[F.lit(k) for k in sorted({r[3] for r in rules})]))

    def matches(rule: Column) -> Column:
        # The start of a hit is the length of the gaps up to it and of the hits before it.
        pairs = F.arrays_zip(F.split(words, rule["regex"], -1).alias("gap"), F.regexp_extract_all(words, rule["regex"], F.lit(0)).alias("hit"))
        size = F.transform(F.filter(pairs, lambda x: x["hit"].isNotNull()), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit")))
        spans = let(size, running)
        return F.transform(spans, lambda x: F.struct(x["s"].alias("start"), (x["s"] - x["e"]).alias("shorter"), rule["priority"], rule["rule_id"], x["e"].alias("end"), rule["label"], rule["score"]))

    once = F.array(held)  # as an element, the keywords are found once a text and not once a rule
    tried = F.element_at(F.transform(once, lambda h: F.filter(table, lambda r: F.array_contains(h, r["keyword"]))), 1)
    return F.array_sort(F.flatten(F.transform(tried, matches)))


def standing(found: Column, longest: Column) -> Column:
    """The detections of an ordered array that do not lie within the interval of one of lower priority value (on ties: a
    longer one, then an earlier rule). What holds a detection stands before it, and not farther than the longest interval:
    so the `NEAR` ones before it are asked, and all before it only where more than those begin so near."""
    rank = lambda x: F.struct(x["priority"], x["shorter"], x["rule_id"])
    inside = lambda x, y: (y["start"] <= x["start"]) & (x["end"] <= y["end"]) & (rank(y) < rank(x))

    def stands(x: Column, i: Column) -> Column:
        dense = (i >= NEAR) & (F.get(found, i - NEAR)["start"] > x["start"] - longest)
        begin = F.when(dense, F.lit(1)).otherwise(F.greatest(i - NEAR + 1, F.lit(1)))
        return ~F.exists(F.slice(found, begin, i - begin + 2), lambda y: inside(x, y))

    return F.filter(found, stands)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_found for every row of docs.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased; null and empty texts have none.
    n_base counts the places of all base phrases, first_word and last_word are the smallest and largest start.
    labels adds those of the signatures that stand after suppression. score is 0 without labels, else the best
    signature's, 0.8 at least with a base phrase. Each row is scanned by itself, whatever other rows share its id;
    there is no shuffle.
    """
    rules = signature_rules()
    words = docs.select("doc_id", normalised(F.col("text")).alias("__words"))
    gate = F.col("__words").rlike("(?i) " + any_of([r[3] for r in rules]) + "(?= )")
    places = words.withColumns({f"__p{i}": phrase_places(F.col("__words"), p) for i, (p, _) in enumerate(PHRASES)})
    places = places.withColumn("__met", F.when(gate, detections(F.col("__words"), rules)))
    places = places.withColumn("__longest", F.array_max(F.transform("__met", lambda x: -x["shorter"])))
    places = places.withColumn("__found", F.when(F.col("__met").isNotNull(), standing(F.col("__met"), F.col("__longest"))))
    ps = [F.col(f"__p{i}") for i in range(len(PHRASES))]
    base = F.array_compact(F.array(*[F.when(p.isNotNull(), label) for p, (_, label) in zip(ps, PHRASES, strict=True)]))
    found = F.coalesce(F.transform("__found", lambda x: x["label"]), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(F.transform("__found", lambda x: x["score"])), F.lit(0.0))
    joined = lambda xs: F.array_join(F.array_sort(F.array_distinct(xs)), ",")
    return places.select(
        "doc_id",
        (blanks(F.col("__words")) - 1).cast("long").alias("n_words"),
        reduce(lambda a, b: a + b, [F.coalesce(p["n"], F.lit(0)) for p in ps]).cast("long").alias("n_base"),
        F.least(*[p["first"] for p in ps]).alias("first_word"),
        F.greatest(*[p["last"] for p in ps]).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, found)).alias("labels"),
        F.greatest(best, F.when(F.size(base) > 0, 0.8).otherwise(0.0)).alias("score"),
        F.coalesce(F.size("__found"), F.lit(0)).cast("long").alias("n_found"),
    )
