"""Signature rules of the licence scan, written by hand.

A family is one licence: its label, how its name is written, the forms of its version, and where its text is found. Each family
gives one rule for each way of naming it; a rule's keyword is taken from its own pattern, so a text without it can't match.
Fields: label ; name regex ; short-name regex ; URL regex. An empty field gives no rule.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    rule_id: int  # order: the smaller wins ties
    label: str
    priority: int  # 3: an explicit tag, 2: a versioned name or address, 1: a bare name
    keyword: str
    pattern: str  # Java syntax, ASCII case ignored
    confidence: float


FAMILIES = r"""
apache-2.0 ; apache\s+(?:software\s+)?licen[sc]e,?\s+(?:version|v\.?)?\s*2(?:\.0)? ; apache[- ]2(?:\.0)?\b ; apache\.org/licenses/LICENSE-2\.0
apache-1.1 ; apache\s+(?:software\s+)?licen[sc]e,?\s+(?:version|v\.?)?\s*1\.1 ; apache[- ]1\.1\b ; apache\.org/licenses/LICENSE-1\.1
apache-1.0 ; apache\s+(?:software\s+)?licen[sc]e,?\s+(?:version|v\.?)?\s*1\.0 ; apache[- ]1\.0\b ; apache\.org/licenses/LICENSE-1\.0
gpl-3.0 ; gnu\s+general\s+public\s+licen[sc]e,?\s+(?:as\s+published\s+by\s+the\s+free\s+software\s+foundation[,;]?\s+(?:either\s+)?)?(?:version|v\.?)\s*3(?:\.0)? ; \bgpl\s*-?v?3(?:\.0)?\b ; gnu\.org/licenses/gpl-3\.0
gpl-2.0 ; gnu\s+general\s+public\s+licen[sc]e,?\s+(?:as\s+published\s+by\s+the\s+free\s+software\s+foundation[,;]?\s+(?:either\s+)?)?(?:version|v\.?)\s*2(?:\.0)? ; \bgpl\s*-?v?2(?:\.0)?\b ; gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
gpl-1.0 ; gnu\s+general\s+public\s+licen[sc]e,?\s+(?:version|v\.?)\s*1(?:\.0)? ; \bgpl\s*-?v?1(?:\.0)?\b ; gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0
lgpl-3.0 ; gnu\s+lesser\s+general\s+public\s+licen[sc]e,?\s+(?:version|v\.?)\s*3(?:\.0)? ; \blgpl\s*-?v?3(?:\.0)?\b ; gnu\.org/licenses/lgpl-3\.0
lgpl-2.1 ; gnu\s+lesser\s+general\s+public\s+licen[sc]e,?\s+(?:version|v\.?)\s*2\.1 ; \blgpl\s*-?v?2\.1\b ; gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
lgpl-2.0 ; gnu\s+library\s+general\s+public\s+licen[sc]e,?\s+(?:version|v\.?)\s*2(?:\.0)? ; \blgpl\s*-?v?2\.0\b ; gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0
agpl-3.0 ; gnu\s+affero\s+general\s+public\s+licen[sc]e,?\s+(?:version|v\.?)\s*3(?:\.0)? ; affero\s+gpl\s*-?v?3 ; affero\.org/oagpl
agpl-3.0-tag ; \bagpl\s*-?v?3(?:\.0)?[- ]or[- ]later ; \bagpl\s*-?v?3(?:\.0)?\b ; gnu\.org/licenses/agpl-3\.0
gfdl-1.3 ; gnu\s+free\s+documentation\s+licen[sc]e,?\s+(?:version|v\.?)\s*1\.3 ; free\s+documentation\s+licen[sc]e\s+1\.3 ; gnu\.org/licenses/fdl-1\.3
gfdl-1.2 ; gnu\s+free\s+documentation\s+licen[sc]e,?\s+(?:version|v\.?)\s*1\.2 ; free\s+documentation\s+licen[sc]e\s+1\.2 ; gnu\.org/licenses/(?:old-licenses/)?fdl-1\.2
mit ; \bmit\s+licen[sc]e\b ; licen[sc]ed\s+under\s+(?:the\s+)?mit\b ; opensource\.org/licenses/mit\b
mit-0 ; \bmit\s+no\s+attribution ; \bmit-0\b ; opensource\.org/licenses/mit-0
x11 ; \bx11\s+licen[sc]e ; \bmit/x11\b ; xfree86\.org/.{0,20}licen[sc]e
expat ; \bexpat\s+licen[sc]e ; \bmit/expat\b ; jclark\.com/xml/copying
bsd-2-clause ; bsd\s+2[- ]clause ; (?:simplified|freebsd)\s+bsd\s+licen[sc]e ; opensource\.org/licenses/bsd-2-clause
bsd-3-clause ; bsd\s+3[- ]clause ; (?:new|revised|modified)\s+bsd\s+licen[sc]e ; opensource\.org/licenses/bsd-3-clause
bsd-4-clause ; bsd\s+4[- ]clause ; (?:original|old)\s+bsd\s+licen[sc]e ; spdx\.org/licenses/bsd-4-clause
bsd-0-clause ; (?:zero[- ]clause|0[- ]clause)\s+bsd ; \b0bsd\b ; opensource\.org/licenses/0bsd
bsd-patent ; bsd\s*[-+]\s*2[- ]clause\s+plus\s+patent ; bsd\s*\+\s*patent ; opensource\.org/licenses/bsdpluspatent
isc ; \bisc\s+licen[sc]e ; licen[sc]ed\s+under\s+(?:the\s+)?isc\b ; opensource\.org/licenses/isc
mpl-2.0 ; mozilla\s+public\s+licen[sc]e,?\s+(?:version|v\.?)?\s*2(?:\.0)? ; \bmpl\s*-?v?2(?:\.0)?\b ; mozilla\.org/(?:en-us/)?mpl/2\.0
mpl-1.1 ; mozilla\s+public\s+licen[sc]e,?\s+(?:version|v\.?)?\s*1\.1 ; \bmpl\s*-?v?1\.1\b ; mozilla\.org/(?:en-us/)?mpl/1\.1
mpl-1.0 ; mozilla\s+public\s+licen[sc]e,?\s+(?:version|v\.?)?\s*1\.0 ; \bmpl\s*-?v?1\.0\b ; mozilla\.org/(?:en-us/)?mpl/1\.0
epl-2.0 ; eclipse\s+public\s+licen[sc]e\s*[-,]?\s*(?:version|v\.?)?\s*2(?:\.0)? ; \bepl\s*-?v?2(?:\.0)?\b ; eclipse\.org/legal/epl-2\.0
epl-1.0 ; eclipse\s+public\s+licen[sc]e\s*[-,]?\s*(?:version|v\.?)?\s*1(?:\.0)? ; \bepl\s*-?v?1(?:\.0)?\b ; eclipse\.org/legal/epl-v10
edl-1.0 ; eclipse\s+distribution\s+licen[sc]e ; eclipse\s+edl ; eclipse\.org/org/documents/edl-v10
cddl-1.1 ; common\s+development\s+and\s+distribution\s+licen[sc]e,?\s+(?:version|v\.?)?\s*1\.1 ; ; oracle\.com/.{0,30}cddl-?1\.1
cddl-1.0 ; common\s+development\s+and\s+distribution\s+licen[sc]e,?\s+(?:version|v\.?)?\s*1\.0 ; ; opensource\.org/licenses/cddl-?1
cpl-1.0 ; common\s+public\s+licen[sc]e\s*(?:version|v\.?)?\s*1\.0 ; ; opensource\.org/licenses/cpl1\.0
eupl-1.2 ; european\s+union\s+public\s+licen[sc]e,?\s+(?:version|v\.?)?\s*1\.2 ; \beupl\s*-?v?1\.2\b ; joinup\.ec\.europa\.eu/.{0,40}eupl
eupl-1.1 ; european\s+union\s+public\s+licen[sc]e,?\s+(?:version|v\.?)?\s*1\.1 ; \beupl\s*-?v?1\.1\b ;
artistic-2.0 ; artistic\s+licen[sc]e,?\s+(?:version|v\.?)?\s*2\.0 ; \bartistic-2\.0\b ; opensource\.org/licenses/artistic-2\.0
artistic-1.0 ; artistic\s+licen[sc]e,?\s+(?:version|v\.?)?\s*1\.0 ; \bartistic-1\.0\b ; opensource\.org/licenses/artistic-1\.0
bsl-1.0 ; boost\s+software\s+licen[sc]e\s*[-,]?\s*(?:version|v\.?)?\s*1\.0 ; boost\s+licen[sc]e ; boost\.org/license_1_0
busl-1.1 ; business\s+source\s+licen[sc]e,?\s+(?:version|v\.?)?\s*1\.1 ; ; mariadb\.com/bsl11
sspl-1.0 ; server\s+side\s+public\s+licen[sc]e ; \bsspl\s*-?v?1\b ; mongodb\.com/licensing/server-side-public-license
elastic-2.0 ; elastic\s+licen[sc]e\s*(?:version|v\.?)?\s*2(?:\.0)? ; ; elastic\.co/licensing/elastic-license
unlicense ; \bthe\s+unlicen[sc]e ; \bunlicen[sc]e\b ; unlicense\.org
wtfpl ; do\s+what\s+the\s+\w+\s+you\s+want\s+to\s+public\s+licen[sc]e ; ; 
wtfpl-tag ; \bwtfpl\s+licen[sc]e ; \bwtfpl\b ; wtfpl\.net
zlib ; zlib\s+licen[sc]e ; zlib/libpng ; zlib\.net/zlib_license
libpng-2.0 ; libpng\s+licen[sc]e\s*(?:version|v\.?)?\s*2 ; \blibpng-2\.0\b ; libpng\.org/pub/png/src/libpng-license
curl ; curl\s+licen[sc]e ; ; curl\.(?:se|haxx\.se)/docs/copyright
openssl ; openssl\s+licen[sc]e ; ; openssl\.org/source/license
php-3.01 ; php\s+licen[sc]e,?\s+(?:version|v\.?)?\s*3\.01 ; ; php\.net/license/3_01
psf-2.0 ; python\s+software\s+foundation\s+licen[sc]e ; ; docs\.python\.org/.{0,20}license
ruby ; ruby\s+licen[sc]e ; ; ruby-lang\.org/.{0,20}licen[sc]e
postgresql ; postgresql\s+licen[sc]e ; ; postgresql\.org/about/licen[sc]e
ncsa ; (?:university\s+of\s+illinois|uiuc)/ncsa\s+open\s+source\s+licen[sc]e ; \bncsa\s+licen[sc]e ; opensource\.org/licenses/ncsa
upl-1.0 ; universal\s+permissive\s+licen[sc]e ; ; oss\.oracle\.com/licenses/upl
ms-pl ; microsoft\s+public\s+licen[sc]e ; ; opensource\.org/licenses/ms-pl
ms-rl ; microsoft\s+reciprocal\s+licen[sc]e ; ; opensource\.org/licenses/ms-rl
osl-3.0 ; open\s+software\s+licen[sc]e\s*,?\s*(?:version|v\.?)?\s*3(?:\.0)? ; ; opensource\.org/licenses/osl-3\.0
afl-3.0 ; academic\s+free\s+licen[sc]e\s*,?\s*(?:version|v\.?)?\s*3(?:\.0)? ; ; opensource\.org/licenses/afl-3\.0
ofl-1.1 ; sil\s+open\s+font\s+licen[sc]e\s*,?\s*(?:version|v\.?)?\s*1\.1 ; open\s+font\s+licen[sc]e ; scripts\.sil\.org/ofl
cecill-2.1 ; cecill\s+(?:free\s+software\s+)?licen[sc]e ; \bcecill(?:-b|-c|-2\.1)?\b ; cecill\.info/licences
mulan-2.0 ; mulan\s+p(?:ermissive|sl)\s*(?:software\s+)?(?:licen[sc]e)?,?\s*(?:version|v\.?)?\s*2 ; mulan\s+psl\s*v?2 ; license\.coscl\.org\.cn/mulanpsl2
odbl-1.0 ; open\s+(?:data\s+commons\s+open\s+)?database\s+licen[sc]e ; open\s+data\s+commons\s+odbl ; opendatacommons\.org/licenses/odbl
odc-by-1.0 ; open\s+data\s+commons\s+attribution\s+licen[sc]e ; odc-by\b ; opendatacommons\.org/licenses/by
pddl-1.0 ; public\s+domain\s+dedication\s+and\s+licen[sc]e ; ; opendatacommons\.org/licenses/pddl
ogl-3.0 ; open\s+government\s+licen[sc]e\s*(?:version|v\.?)?\s*3 ; open\s+government\s+licen[sc]e ; nationalarchives\.gov\.uk/doc/open-government-licence
cc0-1.0 ; \bcc0\s*1\.0\s+universal ; \bcc0(?:-1\.0)?\b ; creativecommons\.org/publicdomain/zero
cc-pdm-1.0 ; public\s+domain\s+mark ; ; creativecommons\.org/publicdomain/mark
cc-by-4.0 ; (?:creative\s+commons\s+attribution|cc[- ]by)[- ](?:\(?cc[- ]by\)?\s+)?4\.0 ; cc[- ]by[- ]v?4\b ; creativecommons\.org/licenses/by/4\.0
cc-by-3.0 ; (?:creative\s+commons\s+attribution|cc[- ]by)[- ](?:\(?cc[- ]by\)?\s+)?3\.0 ; cc[- ]by[- ]v?3\b ; creativecommons\.org/licenses/by/3\.0
cc-by-2.0 ; (?:creative\s+commons\s+attribution|cc[- ]by)[- ](?:\(?cc[- ]by\)?\s+)?2\.[05] ; cc[- ]by[- ]v?2\b ; creativecommons\.org/licenses/by/2\.[05]
cc-by-sa-4.0 ; creative\s+commons\s+attribution[- ]sharealike\s+4\.0 ; cc[- ]by[- ]sa[- ]4\.0 ; creativecommons\.org/licenses/by-sa/4\.0
cc-by-sa-3.0 ; creative\s+commons\s+attribution[- ]sharealike\s+3\.0 ; cc[- ]by[- ]sa[- ]3\.0 ; creativecommons\.org/licenses/by-sa/3\.0
cc-by-nc-4.0 ; creative\s+commons\s+attribution[- ]noncommercial\s+4\.0 ; cc[- ]by[- ]nc[- ]4\.0 ; creativecommons\.org/licenses/by-nc/4\.0
cc-by-nc-3.0 ; creative\s+commons\s+attribution[- ]noncommercial\s+3\.0 ; cc[- ]by[- ]nc[- ]3\.0 ; creativecommons\.org/licenses/by-nc/3\.0
cc-by-nc-sa-4.0 ; creative\s+commons\s+attribution[- ]noncommercial[- ]sharealike\s+4\.0 ; cc[- ]by[- ]nc[- ]sa[- ]4\.0 ; creativecommons\.org/licenses/by-nc-sa/4\.0
cc-by-nc-sa-3.0 ; creative\s+commons\s+attribution[- ]noncommercial[- ]sharealike\s+3\.0 ; cc[- ]by[- ]nc[- ]sa[- ]3\.0 ; creativecommons\.org/licenses/by-nc-sa/3\.0
cc-by-nd-4.0 ; creative\s+commons\s+attribution[- ]noderivatives\s+4\.0 ; cc[- ]by[- ]nd[- ]4\.0 ; creativecommons\.org/licenses/by-nd/4\.0
cc-by-nc-nd-4.0 ; creative\s+commons\s+attribution[- ]noncommercial[- ]noderiv(?:ative)?s\s+4\.0 ; cc[- ]by[- ]nc[- ]nd[- ]4\.0 ; creativecommons\.org/licenses/by-nc-nd/4\.0
"""

#: Bare names, without a version: label ; regex. They give way to any rule of a higher priority that contains them.
BARE = r"""
apache ; apache\s+(?:software\s+)?licen[sc]e
gpl ; gnu\s+general\s+public\s+licen[sc]e
lgpl ; gnu\s+(?:lesser|library)\s+general\s+public\s+licen[sc]e
agpl ; affero\s+general\s+public\s+licen[sc]e
gfdl ; free\s+documentation\s+licen[sc]e
bsd ; \bbsd(?:[- ]style)?\s+licen[sc]e
mpl ; mozilla\s+public\s+licen[sc]e
epl ; eclipse\s+public\s+licen[sc]e
cddl ; \bcddl\b
eupl ; european\s+union\s+public\s+licen[sc]e
artistic ; artistic\s+licen[sc]e
cc-by-sa ; cc[- ]by[- ]sa\b
cc-by-nc ; cc[- ]by[- ]nc\b
cc-by-nd ; cc[- ]by[- ]nd\b
cc-by ; \bcc[- ]by\b
creative-commons ; creative\s+commons\s+licen[sc]e
public-domain ; (?:dedicated\s+to|released\s+into|in)\s+the\s+public\s+domain
all-rights-reserved ; all\s+rights\s+reserved
copyright-notice ; copyright\s+(?:\(c\)\s+|©\s*)?(?:19|20)[0-9]{2}
proprietary ; proprietary\s+(?:and\s+confidential|licen[sc]e)
commercial ; commercial\s+licen[sc]e
shareware ; \bshareware\b
eula ; end[- ]user\s+licen[sc]e\s+agreement
permission-notice ; permission\s+is\s+hereby\s+granted,?\s+free\s+of\s+charge
redistribution-notice ; redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms
warranty-disclaimer ; without\s+warrant(?:y|ies)\s+(?:of\s+any\s+kind|or\s+conditions)
"""


def literal(pattern: str) -> str:
    """The longest run of characters, in lower case, that each match of the pattern holds: what stands outside groups, classes and options."""
    runs, depth = [""], 0
    for atom, often in re.findall(r"(\\.|\[[^]]*\]|.)([?*+]|\{[^}]*\})?", pattern.lower()):
        depth += (atom == "(") - (atom == ")")
        if atom == "|" and not depth:
            return ""
        plain = atom[1:] if atom[0] == "\\" and not atom[1].isalnum() else atom if len(atom) == 1 and atom not in "().^$" else ""
        if depth or not plain or often not in ("", "+"):
            runs.append("")
        else:
            runs[-1] += plain
            if often:
                runs.append("")
    return max(runs, key=len)


def rules() -> list[Rule]:
    """All rules in order: explicit tags, names, short names and addresses of each family, then the bare names."""
    found: list[Rule] = []

    def add(label: str, priority: int, pattern: str, confidence: float) -> None:
        found.append(Rule(len(found), label, priority, literal(pattern), pattern, confidence))

    rows = [[x.strip() for x in line.split(" ;")] for line in FAMILIES.strip().splitlines()]
    for label, *_ in rows:
        if not label.endswith("-tag"):
            add(label, 3, r"spdx-license-identifier:\s*" + label.replace(".", r"\.") + r"(?:-only|-or-later)?(?![0-9A-Za-z.-])", 1.0)
    for label, name, short, url in rows:
        label = label.removesuffix("-tag")
        for pattern, confidence in ((name, 0.95), (short, 0.85), (url, 0.9)):
            if pattern:
                add(label, 2, pattern, confidence)
    for label, pattern in ([x.strip() for x in line.split(" ;")] for line in BARE.strip().splitlines()):
        add(label, 1, pattern, 0.6)
    return found
