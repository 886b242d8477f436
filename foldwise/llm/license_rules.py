"""The signature rules of the license scan.

A rule is a line ``label | priority | keyword | pattern``.  Patterns are written over normalised words: ``(a|b c)``
is a choice, ``[a|b c]`` an optional one, every other word stands for itself.  ``keyword`` is a word that every match
holds; a rule runs only on texts with it.  Priorities: 3 an explicit grant, notice or SPDX tag, 2 a named version, 1 a bare name.
"""

NOTICES = """
gpl | 1 | gnu | gnu general public (license|licence|licenses)
gpl | 1 | gpl | gnu gpl
gpl-1.0 | 2 | gnu | gnu general public (license|licence) [as published by the free software foundation] [either] (version 1|v1) [0]
gpl-2.0 | 2 | gnu | gnu general public (license|licence) [as published by the free software foundation] [either] (version 2|v2) [0]
gpl-3.0 | 2 | gnu | gnu general public (license|licence) [as published by the free software foundation] [either] (version 3|v3) [0]
gpl-2.0 | 2 | gpl | (gnu gpl|gpl) [version|v] (2|2 0|v2|v2 0) [only]
gpl-3.0 | 2 | gpl | (gnu gpl|gpl) [version|v] (3|3 0|v3|v3 0) [only]
gpl-2.0-or-later | 3 | gnu | gnu general public license [as published by the free software foundation] [either] (version 2|v2) [0] [of the license] or (any later version|at your option any later version|later)
gpl-3.0-or-later | 3 | gnu | gnu general public license [as published by the free software foundation] [either] (version 3|v3) [0] [of the license] or (any later version|at your option any later version|later)
gpl-1.0 | 3 | gnu | (licensed|released|distributed) under [the terms of] the gnu general public license [as published by the free software foundation] version 1 [0]
gpl-2.0 | 3 | gnu | (licensed|released|distributed|available) under [the terms of] the gnu general public license [as published by the free software foundation] version 2 [0]
gpl-3.0 | 3 | gnu | (licensed|released|distributed|available) under [the terms of] the gnu general public license [as published by the free software foundation] version 3 [0]
gpl | 3 | gnu | (licensed|released|distributed|available) under [the terms of] the gnu general public license
gpl | 3 | redistribute | you can redistribute it and or modify it under the terms of the gnu general public license
gpl | 3 | warranty | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
lgpl | 1 | lesser | gnu lesser general public (license|licence)
lgpl | 1 | library | gnu library general public (license|licence)
lgpl | 1 | lgpl | (gnu lgpl|lgpl)
lgpl-2.0 | 2 | library | gnu library general public license [as published by the free software foundation] [either] version 2 [0]
lgpl-2.1 | 2 | lesser | gnu lesser general public license [as published by the free software foundation] [either] (version 2 1|v2 1)
lgpl-3.0 | 2 | lesser | gnu lesser general public license [as published by the free software foundation] [either] (version 3|v3) [0]
lgpl-2.1 | 2 | lgpl | lgpl [version|v] (2 1|v2 1)
lgpl-3.0 | 2 | lgpl | lgpl [version|v] (3|3 0|v3|v3 0)
lgpl | 3 | lesser | (licensed|released|distributed|available) under [the terms of] the gnu lesser general public license
agpl | 1 | affero | [gnu] affero general public (license|licence)
agpl | 1 | agpl | (gnu agpl|agpl)
agpl-3.0 | 2 | affero | gnu affero general public license [as published by the free software foundation] [either] (version 3|v3) [0]
agpl-3.0 | 2 | agpl | agpl [version|v] (3|3 0|v3|v3 0)
agpl | 3 | affero | (licensed|released|distributed|available) under [the terms of] the gnu affero general public license
gfdl | 1 | documentation | gnu free documentation (license|licence)
gfdl-1.1 | 2 | documentation | gnu free documentation license version 1 1
gfdl-1.2 | 2 | documentation | gnu free documentation license version 1 2
gfdl-1.3 | 2 | documentation | gnu free documentation license version 1 3
apache | 1 | apache | apache (license|licence|licenses)
apache | 1 | asl | (apache|the) asl [2 0]
apache-1.0 | 2 | apache | apache [software] license [version|v] (1|1 0|v1|v1 0)
apache-1.1 | 2 | apache | apache [software] license [version|v] (1 1|v1 1)
apache-2.0 | 2 | apache | apache [software] license [version|v] (2|2 0|v2|v2 0)
apache-2.0 | 2 | apache | apache (2|2 0) [license|licensed]
apache-2.0 | 3 | apache | (licensed|released|distributed|available) under the [terms of the] apache license [version|v] (2|2 0)
apache | 3 | apache | (licensed|released|distributed|available) under the [terms of the] apache license
apache-2.0 | 3 | apache | www apache org licenses license 2 0
mit | 1 | mit | mit (license|licence|licensed|licenses)
mit | 1 | expat | expat license
mit | 1 | x11 | x11 license
mit | 3 | mit | (licensed|released|distributed|available) under [the terms of] the mit (license|licence)
mit | 3 | mit | opensource org licenses mit [license]
mit | 3 | granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit-0 | 2 | attribution | mit no attribution
bsd | 1 | bsd | bsd (license|licence|licensed|licenses|style license|style)
bsd-0-clause | 2 | bsd | (0|zero) clause bsd [license]
bsd-0-clause | 2 | bsd | bsd (0|zero) clause [license]
bsd-1-clause | 2 | bsd | bsd (1|one) clause [license]
bsd-2-clause | 2 | bsd | (2|two) clause bsd [license]
bsd-2-clause | 2 | bsd | bsd (2|two) clause [license]
bsd-2-clause | 2 | freebsd | freebsd license
bsd-2-clause | 2 | simplified | simplified bsd [license]
bsd-3-clause | 2 | bsd | (3|three) clause bsd [license]
bsd-3-clause | 2 | bsd | bsd (3|three) clause [license]
bsd-3-clause | 2 | bsd | (new|modified|revised) bsd [license]
bsd-4-clause | 2 | bsd | (4|four) clause bsd [license]
bsd-4-clause | 2 | bsd | bsd (4|four) clause [license]
bsd-4-clause | 2 | bsd | (original|old) bsd [license]
bsd | 3 | bsd | (licensed|released|distributed|available) under [the terms of] (the|a) [0|2|3|4] [clause] bsd [style] (license|licence)
bsd | 3 | redistributions | redistributions of source code must retain the above copyright notice
bsd | 3 | redistributions | redistributions in binary form must reproduce the above copyright notice
bsd | 3 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | 3 | endorse | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | 3 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledgement
isc | 1 | isc | isc (license|licence)
isc | 3 | isc | (licensed|released|distributed|available) under [the terms of] the isc license
isc | 3 | granted | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
mpl | 1 | mozilla | mozilla public (license|licence)
mpl-1.0 | 2 | mozilla | mozilla public license [version|v] (1|1 0|v1|v1 0)
mpl-1.1 | 2 | mozilla | mozilla public license [version|v] (1 1|v1 1)
mpl-2.0 | 2 | mozilla | mozilla public license [version|v] (2|2 0|v2|v2 0)
mpl-1.1 | 2 | mpl | mpl [version|v] (1 1|v1 1)
mpl-2.0 | 2 | mpl | mpl [version|v] (2|2 0|v2|v2 0)
mpl | 3 | mozilla | subject to the terms of the mozilla public license
epl | 1 | eclipse | eclipse public (license|licence)
epl-1.0 | 2 | eclipse | eclipse public license [version|v] (1|1 0|v1|v1 0)
epl-2.0 | 2 | eclipse | eclipse public license [version|v] (2|2 0|v2|v2 0)
edl-1.0 | 2 | eclipse | eclipse distribution license [version|v] (1|1 0|v1|v1 0)
eupl | 1 | european | european union public (license|licence)
eupl-1.1 | 2 | eupl | eupl [version|v] (1 1|v1 1)
eupl-1.2 | 2 | eupl | eupl [version|v] (1 2|v1 2)
cddl | 1 | cddl | cddl
cddl | 1 | distribution | common development and distribution (license|licence)
cddl-1.0 | 2 | distribution | common development and distribution license [cddl] [version|v] (1|1 0|v1 0)
cddl-1.1 | 2 | distribution | common development and distribution license [cddl] [version|v] (1 1|v1 1)
cpl-1.0 | 2 | common | common public license [version|v] (1|1 0|v1 0)
cpal-1.0 | 2 | attribution | common public attribution license [version|v] (1|1 0)
artistic | 1 | artistic | [perl] artistic (license|licence)
artistic-1.0 | 2 | artistic | artistic license [version|v] (1|1 0|v1 0)
artistic-2.0 | 2 | artistic | artistic license [version|v] (2|2 0|v2 0)
perl | 2 | perl | under the same terms as perl itself
boost-1.0 | 1 | boost | boost software (license|licence) [version|v] [1 0]
zlib | 1 | zlib | zlib [libpng] (license|licence)
zlib | 3 | altered | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
libpng | 1 | libpng | libpng license
unlicense | 1 | unlicense | [the] unlicense
unlicense | 3 | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | 1 | wtfpl | wtfpl
wtfpl | 3 | fuck | do what the fuck you want to public license
public-domain | 1 | domain | public domain
public-domain | 3 | domain | (released|placed|dedicated) (into|in|to) the public domain
python-2.0 | 2 | python | python software foundation license [version|v] [2|2 0]
psf | 1 | psf | psf (license|licence)
php | 1 | php | php (license|licence)
php-3.01 | 2 | php | php license version 3 01
ruby | 1 | ruby | ruby (license|licence)
openssl | 1 | openssl | openssl (license|licence)
ofl-1.1 | 2 | ofl | (sil ofl|ofl) [version|v] (1 1|v1 1)
ofl | 1 | sil | sil open font (license|licence)
ofl-1.0 | 2 | sil | sil open font license version 1 0
ofl-1.1 | 2 | sil | sil open font license version 1 1
ncsa | 1 | ncsa | (university of illinois ncsa open source|ncsa) (license|licence)
ms-pl | 1 | microsoft | microsoft public (license|licence)
ms-rl | 1 | microsoft | microsoft reciprocal (license|licence)
afl-3.0 | 1 | academic | academic free license [version|v] [3|3 0|2 1]
osl-3.0 | 1 | osl | osl 3 0
osl | 1 | open | open software (license|licence) [version|v] [3|3 0]
qpl-1.0 | 1 | qpl | qpl [1 0]
qpl-1.0 | 1 | q | q public license [1 0]
vim | 1 | vim | vim license
beerware | 1 | beerware | beerware [license]
beerware | 3 | beer | you can buy me a beer in return
postgresql | 1 | postgresql | postgresql (license|licence)
curl | 1 | curl | curl license
json | 3 | evil | the software shall be used for good not evil
odbl | 1 | odbl | odbl [1 0]
odbl | 1 | database | open (database|data commons open database) (license|licence) [odbl]
odc-by | 1 | commons | open data commons attribution license
pddl | 1 | pddl | pddl [1 0]
openrail | 1 | openrail | (openrail|openrail m|creativeml openrail m) [license]
openrail | 1 | rail | open rail m [license]
sspl-1.0 | 1 | sspl | sspl [1 0|1]
sspl-1.0 | 1 | side | server side public license [version] [1]
busl-1.1 | 1 | business | business source license [version] [1 1]
busl-1.1 | 1 | bsl | bsl (1 1|license)
elastic-2.0 | 1 | elastic | elastic license [version|v] [2|2 0]
commons-clause | 2 | commons | commons clause license condition [v1 0]
commons-clause | 1 | commons | commons clause
proprietary | 1 | rights | all rights reserved
proprietary | 2 | proprietary | (proprietary and confidential|confidential and proprietary)
proprietary | 3 | reproduced | no part of this (publication|book|work|document) may be reproduced
copyright-notice | 1 | copyright | copyright [c] (holder|holders|notice|owner|owners)
non-commercial | 2 | noncommercial | for noncommercial (use|purposes) only
non-commercial | 2 | commercial | for (non commercial|personal non commercial) (use|purposes) only
cc | 1 | creative | creative commons [license|licence|licenses]
cc-by | 1 | cc | cc by
cc-by | 2 | creative | creative commons attribution [license|licence]
cc-by-sa | 2 | creative | creative commons attribution (share alike|sharealike) [license|licence]
cc-by-nc | 2 | creative | creative commons attribution (non commercial|noncommercial) [license|licence]
cc-by-nd | 2 | creative | creative commons attribution (no derivatives|noderivatives|no derivs|noderivs) [license|licence]
cc-by-nc-sa | 2 | creative | creative commons attribution (non commercial|noncommercial) (share alike|sharealike) [license|licence]
cc-by-nc-nd | 2 | creative | creative commons attribution (non commercial|noncommercial) (no derivatives|noderivatives|no derivs|noderivs) [license|licence]
cc0-1.0 | 2 | cc0 | [creative commons] cc0 [1 0] [universal]
cc0-1.0 | 2 | creative | creative commons zero [1 0] [universal]
"""
#: Variants that take the versions below: as short names, as links and in a grant.
CC_VARIANTS = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: Identifiers after "SPDX-License-Identifier:".
SPDX = ("GPL-1.0-only GPL-1.0-or-later GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.0-only LGPL-2.1-only LGPL-2.1-or-later "
        "LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 MIT MIT-0 BSD-2-Clause BSD-3-Clause BSD-4-Clause 0BSD ISC "
        "MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 CDDL-1.0 CDDL-1.1 Artistic-1.0 Artistic-2.0 BSL-1.0 Zlib Unlicense WTFPL CC0-1.0 CC-BY-3.0 "
        "CC-BY-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 OFL-1.1 NCSA PostgreSQL PSF-2.0 Python-2.0 SSPL-1.0 BUSL-1.1").split()


def lines() -> list[tuple[str, int, str, str]]:
    """(label, priority, keyword, pattern) of all rules, in order."""
    rules = [(a, int(b), c, d) for a, b, c, d in ((x.strip() for x in line.split(" | ", 3)) for line in NOTICES.strip().splitlines())]
    for variant in CC_VARIANTS:
        name = "cc-" + variant.replace(" ", "-")
        if variant != "by":
            rules.append((name, 1, "cc", f"cc {variant}"))
        for version in CC_VERSIONS:
            label = f"{name}-{version.replace(' ', '.')}"
            rules += [(label, 2, "cc", f"cc {variant} {version} [international|unported]"),
                      (label, 3, "creativecommons", f"creativecommons org licenses {variant} {version}"),
                      (label, 3, "cc", f"(licensed|released|distributed|available) under [a|the] cc {variant} {version} [license|licence]")]
    rules += [(x.lower(), 3, "spdx", "spdx license identifier " + x.lower().replace("-", " ").replace(".", " ")) for x in SPDX]
    return rules


def word_regex(pattern: str) -> str:
    """A pattern over text in which every word stands between two spaces of its own, so that neighbours share none."""
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        if c in "([":
            end = pattern.index(")" if c == "(" else "]", at)
            choices = "|".join("".join(f" {w} " for w in x.split()) for x in sorted(pattern[at + 1:end].split("|"), key=lambda x: -len(x.split())))
            out.append(f"(?:{choices})" + "?" * (c == "["))
            at = end + 1
        elif c == " ":
            at += 1
        else:
            end = min((k for k in (pattern.find(x, at) for x in " ([") if k >= 0), default=len(pattern))
            out.append(f" {pattern[at:end]} ")
            at = end
    return "".join(out)
