"""Licence scans with DataFrame functions alone: ordered signature rules behind keywords, and suppression of contained finds."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.llm.common import digest, settled, text_or_empty

SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
#: The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label; SPDX names; the name as an expression; gate and keyword, in lower case and with single spaces,
#: that every match of the name holds once its runs of blanks are one space.
_L = r"licen[cs]e"
_V = r"(?:,?\s*(?:version|ver\.?|v\.?)?\s*)"
FAMILIES = (
    ("0bsd", r"0BSD", rf"(?:Zero[- ]Clause\s+BSD|0BSD)(?:\s+{_L})?", "bsd", "bsd"),
    ("afl", r"AFL-[123]\.[0-2]", rf"Academic\s+Free\s+{_L}(?:{_V}[123]\.[0-2])?", "licen", "academic free"),
    (
        "agpl", r"AGPL-[13]\.0(?:-only|-or-later|\+)?",
        rf"(?:GNU\s+)?Affero\s+General\s+Public\s+{_L}(?:{_V}[13](?:\.0)?)?", "licen", "affero",
    ),
    ("agpl", r"AGPL", r"AGPL(?:[- ]?v?[13](?:\.0)?)?(?:\+|[- ]or[- ]later)?", "gpl", "agpl"),
    (
        "apache", r"Apache-(?:1\.[01]|2\.0)", rf"Apache\s+(?:Software\s+)?{_L}(?:{_V}(?:1\.[01]|2(?:\.0)?))?",
        "licen", "apache",
    ),
    ("apache", r"ASL-2\.0", r"Apache[- ]2(?:\.0)?(?:\s+licen[cs]ed?)?", "apache", "apache"),
    ("apsl", r"APSL-[12]\.[0-2]", rf"Apple\s+Public\s+Source\s+{_L}(?:{_V}[12]\.[0-2])?", "licen", "apple public"),
    ("artistic", r"Artistic-[12]\.0(?:-Perl|-cl8)?", rf"Artistic\s+{_L}(?:{_V}[12](?:\.0)?)?", "licen", "artistic"),
    ("blueoak", r"BlueOak-1\.0\.0", rf"Blue\s+Oak\s+Model\s+{_L}(?:{_V}1\.0\.0)?", "licen", "blue oak"),
    ("boost", r"BSL-1\.0", rf"Boost\s+Software\s+{_L}(?:{_V}1\.0)?", "licen", "boost"),
    (
        "bsd", r"BSD-[1234]-Clause(?:-\w+)?",
        rf"(?:(?:[234]|two|three|four|new|modified|simplified|revised|original)[- ]?(?:clause)?[- ]+)?BSD(?:[- ][234][- ]clause)?(?:[- ]style)?\s+{_L}",
        "licen", "bsd",
    ),
    ("bsd", r"BSD", r"BSD[- ][1234][- ]Clause", "bsd", "bsd"),
    ("busl", r"BUSL-1\.1", rf"Business\s+Source\s+{_L}(?:{_V}1\.1)?", "licen", "business source"),
    ("cc0", r"CC0-1\.0", r"(?:Creative\s+Commons\s+)?CC0(?:\s+(?:v?1\.0|Universal))*", "cc0", "cc0"),
    ("cc0", r"CC0", r"Creative\s+Commons\s+Zero(?:\s+(?:v?1\.0|Universal))*", "creative commons", "zero"),
    ("cc-by", r"CC-BY-[1234]\.[05]", r"CC-BY(?![- ](?:NC|SA|ND))(?:[- ][1234]\.[05])?", "cc-by", "by"),
    ("cc-by", r"CC-BY", r"CC\s+BY(?![- ](?:NC|SA|ND))(?:[- ][1234]\.[05])?", "cc by", "by"),
    ("cc-by-nc", r"CC-BY-NC-[1234]\.[05]", r"CC-BY[- ]NC(?![- ](?:SA|ND))(?:[- ][1234]\.[05])?", "cc-by", "nc"),
    ("cc-by-nc", r"CC-BY-NC", r"CC\s+BY[- ]NC(?![- ](?:SA|ND))(?:[- ][1234]\.[05])?", "cc by", "nc"),
    ("cc-by-nd", r"CC-BY-ND-[1234]\.[05]", r"CC-BY[- ]ND(?:[- ][1234]\.[05])?", "cc-by", "nd"),
    ("cc-by-nd", r"CC-BY-ND", r"CC\s+BY[- ]ND(?:[- ][1234]\.[05])?", "cc by", "nd"),
    ("cc-by-sa", r"CC-BY-SA-[1234]\.[05]", r"CC-BY[- ]SA(?:[- ][1234]\.[05])?", "cc-by", "sa"),
    ("cc-by-sa", r"CC-BY-SA", r"CC\s+BY[- ]SA(?:[- ][1234]\.[05])?", "cc by", "sa"),
    ("cc-by-nc-nd", r"CC-BY-NC-ND-[1234]\.[05]", r"CC-BY[- ]NC[- ]ND(?:[- ][1234]\.[05])?", "cc-by", "nd"),
    ("cc-by-nc-nd", r"CC-BY-NC-ND", r"CC\s+BY[- ]NC[- ]ND(?:[- ][1234]\.[05])?", "cc by", "nd"),
    ("cc-by-nc-sa", r"CC-BY-NC-SA-[1234]\.[05]", r"CC-BY[- ]NC[- ]SA(?:[- ][1234]\.[05])?", "cc-by", "sa"),
    ("cc-by-nc-sa", r"CC-BY-NC-SA", r"CC\s+BY[- ]NC[- ]SA(?:[- ][1234]\.[05])?", "cc by", "sa"),
    (
        "cc-by", r"CC-BY", r"Creative\s+Commons\s+Attribution(?![- ](?:Share|Non|No))(?:\s+[1234]\.[05])?",
        "creative commons", "attribution",
    ),
    (
        "cc-by-sa", r"CC-BY-SA", r"Creative\s+Commons\s+Attribution[- ]Share[- ]?Alike(?:\s+[1234]\.[05])?",
        "creative commons", "alike",
    ),
    (
        "cc-by-nc", r"CC-BY-NC",
        r"Creative\s+Commons\s+Attribution[- ]Non[- ]?Commercial(?![- ](?:Share|No))(?:\s+[1234]\.[05])?",
        "creative commons", "commercial",
    ),
    (
        "cc-by-nd", r"CC-BY-ND",
        r"Creative\s+Commons\s+Attribution[- ]No[- ]?Deriv(?:ative)?s?(?:\s+[1234]\.[05])?", "creative commons",
        "deriv",
    ),
    (
        "cc-by-nc-sa", r"CC-BY-NC-SA",
        r"Creative\s+Commons\s+Attribution[- ]Non[- ]?Commercial[- ]Share[- ]?Alike(?:\s+[1234]\.[05])?",
        "creative commons", "alike",
    ),
    (
        "cc-by-nc-nd", r"CC-BY-NC-ND",
        r"Creative\s+Commons\s+Attribution[- ]Non[- ]?Commercial[- ]No[- ]?Deriv(?:ative)?s?(?:\s+[1234]\.[05])?",
        "creative commons", "deriv",
    ),
    (
        "cddl", r"CDDL-1\.[01]", rf"Common\s+Development\s+and\s+Distribution\s+{_L}(?:{_V}1\.[01])?", "licen",
        "development and",
    ),
    (
        "cecill", r"CECILL-(?:1\.[01]|2\.[01]|B|C)", rf"CeCILL(?:[- ][BC])?(?:\s+(?:Free\s+Software\s+)?{_L})",
        "licen", "cecill",
    ),
    ("cpal", r"CPAL-1\.0", rf"Common\s+Public\s+Attribution\s+{_L}(?:{_V}1\.0)?", "licen", "common public"),
    ("cpl", r"CPL-1\.0", rf"Common\s+Public\s+{_L}(?:{_V}1\.0)?", "licen", "common public"),
    ("ecl", r"ECL-[12]\.0", rf"Educational\s+Community\s+{_L}(?:{_V}[12]\.0)?", "licen", "educational"),
    ("efl", r"EFL-[12]\.0", rf"Eiffel\s+Forum\s+{_L}(?:{_V}[12])?", "licen", "eiffel"),
    ("elastic", r"Elastic-2\.0", rf"Elastic\s+{_L}(?:{_V}2(?:\.0)?)?", "licen", "elastic"),
    ("epl", r"EPL-[12]\.0", rf"Eclipse\s+Public\s+{_L}(?:[- ]+v?\s*[12]\.0|{_V}[12]\.0)?", "licen", "eclipse"),
    (
        "eupl", r"EUPL-1\.[0-2]", rf"European\s+Union\s+Public\s+Licen[cs]e(?:{_V}1\.[0-2])?", "licen",
        "european union",
    ),
    ("fair", r"Fair", r"Fair\s+License", "licen", "fair"),
    ("ftl", r"FTL", rf"FreeType\s+(?:Project\s+)?{_L}", "licen", "freetype"),
    (
        "gfdl", r"GFDL-1\.[123](?:-\w+)*", rf"(?:GNU\s+)?Free\s+Documentation\s+{_L}(?:{_V}1\.[123])?", "licen",
        "free documentation",
    ),
    (
        "gpl", r"GPL-[123]\.0(?:-only|-or-later|\+)?(?:-with-[\w-]+)?",
        rf"(?:GNU\s+)?(?<!Affero\s)(?<!Lesser\s)(?<!Library\s)General\s+Public\s+{_L}(?:{_V}[123](?:\.0)?)?(?:\s+or\s+(?:any\s+)?later)?",
        "licen", "general public",
    ),
    ("gpl", r"GPL", r"(?<![AL])GPL(?:[- ]?v?[123](?:\.0)?)?(?:\+|[- ]or[- ]later)?", "gpl", "gpl"),
    (
        "hpnd", r"HPND(?:-\w+)?", r"Historical\s+Permission\s+Notice\s+and\s+Disclaimer", "notice and disclaimer",
        "historical",
    ),
    ("imagemagick", r"ImageMagick", rf"ImageMagick\s+{_L}", "licen", "imagemagick"),
    ("intel", r"Intel", rf"Intel\s+(?:Open\s+Source|Simplified\s+Software)\s+{_L}", "licen", "intel"),
    ("ipl", r"IPL-1\.0", rf"IBM\s+Public\s+{_L}(?:{_V}1\.0)?", "licen", "ibm public"),
    ("isc", r"ISC", rf"ISC(?:[- ]style)?\s+{_L}", "licen", "isc"),
    (
        "lgpl", r"LGPL-(?:2\.[01]|3\.0)(?:-only|-or-later|\+)?",
        rf"(?:GNU\s+)?(?:Lesser|Library)\s+General\s+Public\s+{_L}(?:{_V}(?:2(?:\.[01])?|3(?:\.0)?))?", "licen",
        "general public",
    ),
    ("lgpl", r"LGPL", r"LGPL(?:[- ]?v?(?:2(?:\.[01])?|3(?:\.0)?))?(?:\+|[- ]or[- ]later)?", "gpl", "lgpl"),
    ("libpng", r"libpng(?:-2\.0)?", rf"(?:PNG\s+Reference\s+Library|libpng)\s+{_L}(?:{_V}2)?", "licen", "png"),
    (
        "lppl", r"LPPL-1\.[0-3][ac]?", rf"LaTeX\s+Project\s+Public\s+{_L}(?:{_V}1\.[0-3][ac]?)?", "licen",
        "latex project",
    ),
    ("mit", r"MIT(?:-0|-\w+)?", rf"MIT(?:[/ ](?:X11|Expat))?(?:[- ]style)?\s+{_L}", "licen", "mit"),
    ("mit", r"Expat", rf"Expat(?:[/ ](?:X11|Expat))?(?:[- ]style)?\s+{_L}", "licen", "expat"),
    ("mit-0", r"MIT-0", rf"MIT\s+No\s+Attribution(?:\s+{_L})?", "attribution", "mit no"),
    (
        "mpl", r"MPL-[12]\.[01](?:-no-copyleft-exception)?", rf"Mozilla\s+Public\s+{_L}(?:{_V}[12]\.[01])?",
        "licen", "mozilla",
    ),
    ("mpl", r"MPL", r"MPL[- ]?v?[12]\.[01]", "mpl", "mpl"),
    ("ms-pl", r"MS-PL", rf"Microsoft\s+Public\s+{_L}", "licen", "microsoft"),
    ("ms-rl", r"MS-RL", rf"Microsoft\s+Reciprocal\s+{_L}", "licen", "microsoft"),
    (
        "mulanpsl", r"MulanPSL-[12]\.0", rf"Mulan\s+(?:PSL|Permissive\s+Software\s+{_L})(?:{_V}[12])?", "mulan",
        "mulan",
    ),
    ("ncsa", r"NCSA", rf"(?:University\s+of\s+Illinois/)?NCSA\s+(?:Open\s+Source\s+)?{_L}", "licen", "ncsa"),
    ("odbl", r"ODbL-1\.0", rf"Open\s+(?:Data\s+Commons\s+Open\s+)?Database\s+{_L}(?:{_V}1\.0)?", "licen", "database"),
    ("odc-by", r"ODC-By-1\.0", rf"Open\s+Data\s+Commons\s+Attribution\s+{_L}(?:{_V}1\.0)?", "licen", "data commons"),
    ("ofl", r"OFL-1\.[01](?:-RFN|-no-RFN)?", rf"(?:SIL\s+)?Open\s+Font\s+{_L}(?:{_V}1\.[01])?", "licen", "open font"),
    ("openldap", r"OLDAP-[12]\.[0-8]", rf"OpenLDAP\s+Public\s+{_L}(?:{_V}[12]\.[0-8])?", "licen", "openldap"),
    ("openssl", r"OpenSSL", rf"OpenSSL\s+(?:and\s+SSLeay\s+)?{_L}", "licen", "openssl"),
    ("osl", r"OSL-[123]\.[01]", rf"Open\s+Software\s+{_L}(?:{_V}[123]\.[01])?", "licen", "open software"),
    ("pddl", r"PDDL-1\.0", rf"Public\s+Domain\s+Dedication\s+(?:and|&)\s+{_L}", "licen", "public domain"),
    ("php", r"PHP-3\.0[01]?", rf"PHP\s+{_L}(?:{_V}3\.0[01]?)?", "licen", "php"),
    ("postgresql", r"PostgreSQL", rf"PostgreSQL\s+{_L}", "licen", "postgresql"),
    (
        "python", r"(?:PSF-2\.0|Python-2\.0(?:\.1)?)",
        rf"(?:Python\s+Software\s+Foundation|PSF|Python)\s+{_L}(?:{_V}2(?:\.0)?)?", "licen", "licen",
    ),
    ("qpl", r"QPL-1\.0", rf"Q\s+Public\s+{_L}(?:{_V}1\.0)?", "licen", "q public"),
    ("ruby", r"Ruby", rf"Ruby(?:'s)?\s+{_L}", "licen", "ruby"),
    ("sleepycat", r"Sleepycat", rf"Sleepycat\s+{_L}", "licen", "sleepycat"),
    ("sspl", r"SSPL-1\.0", rf"Server\s+Side\s+Public\s+{_L}(?:{_V}1)?", "licen", "server side"),
    (
        "unicode", r"Unicode-(?:DFS-201[56]|3\.0)", rf"Unicode\s+(?:Terms\s+of\s+Use\s+and\s+)?{_L}(?:\s+v3)?",
        "licen", "unicode",
    ),
    ("unlicense", r"Unlicense", r"(?:The\s+)?Unlicense", "unlicen", "unlicense"),
    ("upl", r"UPL-1\.0", rf"Universal\s+Permissive\s+{_L}(?:{_V}1\.0)?", "licen", "universal permissive"),
    ("vim", r"Vim", rf"Vim\s+{_L}", "licen", "vim"),
    ("w3c", r"W3C(?:-\d+)?", rf"W3C(?:\s+Software(?:\s+Notice)?(?:\s+and)?)?\s+{_L}", "licen", "w3c"),
    ("wtfpl", r"WTFPL", r"WTFPL", "wtfpl", "wtfpl"),
    ("wtfpl", r"WTFPL", r"Do\s+What\s+The\s+F\S{0,3}\s+You\s+Want\s+To\s+Public\s+License", "licen", "do what the f"),
    ("x11", r"X11", rf"X11\s+{_L}", "licen", "x11"),
    ("zlib", r"Zlib", rf"(?:zlib(?:/libpng)?)\s+{_L}", "licen", "zlib"),
    ("zpl", r"ZPL-[12]\.[01]", rf"Zope\s+Public\s+{_L}(?:{_V}[12]\.[01])?", "licen", "zope"),
)
#: Label, confidence, expression, gate, keyword; texts of licences, places of licences, and general notices.
OTHERS = (
    (
        "mit", 0.95,
        r"Permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+obtaining\s+a\s+copy",
        "permission", "hereby granted",
    ),
    (
        "isc", 0.95,
        r"Permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute\s+this\s+software\s+for\s+any\s+purpose",
        "permission", "for any purpose",
    ),
    (
        "bsd", 0.95,
        r"Redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms,\s+with\s+or\s+without\s+modification",
        "redistribution", "binary forms",
    ),
    (
        "zlib", 0.95,
        r"This\s+software\s+is\s+provided\s+'as-is',\s+without\s+any\s+express\s+or\s+implied\s+warranty", "as-is",
        "implied warranty",
    ),
    (
        "boost", 0.95,
        r"Permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+or\s+organization",
        "permission", "or organization",
    ),
    (
        "unlicense", 0.95,
        r"This\s+is\s+free\s+and\s+unencumbered\s+software\s+released\s+into\s+the\s+public\s+domain",
        "public domain", "unencumbered",
    ),
    (
        "gpl", 0.95,
        r"This\s+program\s+is\s+free\s+software[:;]\s+you\s+can\s+redistribute\s+it\s+and/or\s+modify",
        "redistribut", "free software",
    ),
    (
        "lgpl", 0.95,
        r"This\s+library\s+is\s+free\s+software[:;]\s+you\s+can\s+redistribute\s+it\s+and/or\s+modify",
        "redistribut", "this library",
    ),
    (
        "mpl", 0.95, r"This\s+Source\s+Code\s+Form\s+is\s+subject\s+to\s+the\s+terms\s+of\s+the\s+Mozilla",
        "subject to", "source code form",
    ),
    (
        "public-domain", 0.8, r"(?:released|dedicated|placed)\s+(?:in)?to\s+the\s+public\s+domain",
        "public domain", "public domain",
    ),
    ("public-domain", 0.7, r"(?:is|are)\s+in\s+the\s+public\s+domain", "public domain", "public domain"),
    ("proprietary", 0.6, r"All\s+rights\s+reserved", "rights reserved", "all rights"),
    (
        "proprietary", 0.8, r"(?:proprietary\s+and\s+confidential|confidential\s+and\s+proprietary)",
        "proprietary", "confidential",
    ),
    (
        "proprietary", 0.7,
        r"may\s+not\s+be\s+(?:copied|reproduced|redistributed)\s+without\s+(?:prior\s+)?(?:written\s+)?permission",
        "permission", "may not be",
    ),
    ("mit", 0.9, r"https?://(?:www\.)?opensource\.org/licen[cs]es?/mit\b", "opensource.org", "/mit"),
    ("bsd", 0.9, r"https?://(?:www\.)?opensource\.org/licen[cs]es?/bsd[\w-]*", "opensource.org", "/bsd"),
    ("isc", 0.9, r"https?://(?:www\.)?opensource\.org/licen[cs]es?/isc[\w-]*", "opensource.org", "/isc"),
    ("gpl", 0.9, r"https?://(?:www\.)?opensource\.org/licen[cs]es?/gpl[\w.-]*", "opensource.org", "/gpl"),
    ("apache", 0.9, r"https?://(?:www\.)?apache\.org/licen[cs]es/LICEN[CS]E-2\.0\b", "apache.org", "licen"),
    ("gpl", 0.9, r"https?://(?:www\.)?gnu\.org/licen[cs]es/(?:old-licenses/)?gpl[\w.-]*", "gnu.org", "/gpl"),
    ("lgpl", 0.9, r"https?://(?:www\.)?gnu\.org/licen[cs]es/(?:old-licenses/)?lgpl[\w.-]*", "gnu.org", "/lgpl"),
    ("agpl", 0.9, r"https?://(?:www\.)?gnu\.org/licen[cs]es/agpl[\w.-]*", "gnu.org", "/agpl"),
    ("gfdl", 0.9, r"https?://(?:www\.)?gnu\.org/licen[cs]es/fdl[\w.-]*", "gnu.org", "/fdl"),
    ("mpl", 0.9, r"https?://(?:www\.)?mozilla\.org/(?:[\w-]+/)?MPL/?(?:[12]\.[01])?", "mozilla.org", "mpl"),
    ("epl", 0.9, r"https?://(?:www\.)?eclipse\.org/legal/epl[\w.-]*", "eclipse.org", "epl"),
    ("cc-by", 0.9, r"https?://creativecommons\.org/licenses/by/[1234]\.[05]", "creativecommons.org", "/by/"),
    ("cc-by-sa", 0.9, r"https?://creativecommons\.org/licenses/by-sa/[1234]\.[05]", "creativecommons.org", "/by-sa/"),
    ("cc-by-nc", 0.9, r"https?://creativecommons\.org/licenses/by-nc/[1234]\.[05]", "creativecommons.org", "/by-nc/"),
    ("cc-by-nd", 0.9, r"https?://creativecommons\.org/licenses/by-nd/[1234]\.[05]", "creativecommons.org", "/by-nd/"),
    (
        "cc-by-nc-sa", 0.9, r"https?://creativecommons\.org/licenses/by-nc-sa/[1234]\.[05]", "creativecommons.org",
        "/by-nc-sa/",
    ),
    (
        "cc-by-nc-nd", 0.9, r"https?://creativecommons\.org/licenses/by-nc-nd/[1234]\.[05]", "creativecommons.org",
        "/by-nc-nd/",
    ),
    ("cc0", 0.9, r"https?://creativecommons\.org/publicdomain/zero/1\.0", "creativecommons.org", "/zero/"),
    ("boost", 0.9, r"https?://(?:www\.)?boost\.org/LICENSE_1_0\.txt", "boost.org", "licen"),
    ("unlicense", 0.9, r"https?://(?:www\.)?unlicense\.org\b", "unlicense.org", "unlicense"),
    ("ofl", 0.9, r"https?://scripts\.sil\.org/OFL\b", "sil.org", "ofl"),
    ("unknown", 0.4, r"licen[cs]ed\s+under\s+(?:the\s+)?(?:terms|conditions)\s+of", "licen", "under"),
    (
        "unknown", 0.4, r"see\s+(?:the\s+)?(?:file\s+)?(?:LICEN[CS]E|COPYING)(?:\.\w+)?\s+(?:file\s+)?for", "see ",
        "for",
    ),
)


#: Label, confidence, phrase; clauses, warranty texts, headers and exceptions of licences in their own words.
PHRASED = (
    ("mit", 0.9, "the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", 0.9, "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software"),
    ("mit", 0.8, "in no event shall the authors or copyright holders be liable for any claim"),
    ("mit", 0.7, "without warranty of any kind, express or implied, including but not limited to the warranties of merchantability"),
    ("bsd", 0.9, "redistributions of source code must retain the above copyright notice"),
    ("bsd", 0.9, "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", 0.9, "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", 0.9, "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd", 0.8, "this software is provided by the copyright holders and contributors"),
    ("bsd", 0.8, "this software is provided by the regents and contributors"),
    ("bsd", 0.8, "the views and conclusions contained in the software and documentation are those of the authors"),
    ("apache", 0.9, "you may not use this file except in compliance with the license"),
    ("apache", 0.8, "see the license for the specific language governing permissions and limitations under the license"),
    ("apache", 0.8, "unless required by applicable law or agreed to in writing, software distributed under the license"),
    ("apache", 0.9, "subject to the terms and conditions of this license, each contributor hereby grants to you a perpetual"),
    ("apache", 0.9, "this product includes software developed by the apache software foundation"),
    ("apache", 0.9, "licensed to the apache software foundation (asf) under one or more contributor license agreements"),
    ("gpl", 0.9, "along with this program; if not, write to the free software foundation"),
    ("gpl", 0.9, "you should have received a copy of the gnu general public license"),
    ("gpl", 0.8, "this program is distributed in the hope that it will be useful, but without any warranty"),
    ("gpl", 0.9, "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl", 0.9, "the gnu general public license is a free, copyleft license for software and other kinds of works"),
    ("gpl", 0.7, "everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("gpl", 0.8, "either version 2 of the license, or (at your option) any later version"),
    ("gpl", 0.8, "either version 3 of the license, or (at your option) any later version"),
    ("lgpl", 0.9, "either version 2.1 of the license, or (at your option) any later version"),
    ("lgpl", 0.9, "you should have received a copy of the gnu lesser general public license"),
    ("lgpl", 0.9, "you should have received a copy of the gnu library general public license"),
    ("lgpl", 0.8, "this library is distributed in the hope that it will be useful, but without any warranty"),
    ("lgpl", 0.9, "this license, the lesser general public license, applies to some specially designated software packages"),
    ("agpl", 0.9, "you should have received a copy of the gnu affero general public license"),
    ("agpl", 0.9, "your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("gpl-exception", 0.9, "linking this library statically or dynamically with other modules is making a combined work"),
    ("gpl-exception", 0.9, "as a special exception, the copyright holders give you permission to link"),
    ("gpl-exception", 0.9, "permission to link the code of portions of this program with the openssl library"),
    ("gpl-exception", 0.9, "you may create a larger work that contains part or all of the bison parser skeleton"),
    ("gpl-exception", 0.9, "this exception is an additional permission under section 7 of the gnu general public license"),
    ("gpl-exception", 0.9, "as a special exception, if you create a document which uses this font"),
    ("gpl-exception", 0.8, "under the terms of the gcc runtime library exception"),
    ("mpl", 0.9, "if a copy of the mpl was not distributed with this file, you can obtain one at"),
    ("mpl", 0.9, "the contents of this file are subject to the mozilla public license version"),
    ("mpl", 0.8, "exhibit a - source code form license notice"),
    ("epl", 0.9, "the accompanying program is provided under the terms of this eclipse public license"),
    ("epl", 0.9, "this program and the accompanying materials are made available under the terms of the eclipse"),
    ("cpl", 0.9, "the accompanying program is provided under the terms of this common public license"),
    ("ipl", 0.9, "the accompanying program is provided under the terms of this ibm public license"),
    ("cddl", 0.9, "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl", 0.9, "when distributing covered code, include this cddl header"),
    ("isc", 0.8, "the author disclaims all warranties with regard to this software"),
    ("isc", 0.9, "isc disclaims all warranties with regard to this software"),
    ("0bsd", 0.9, "distribute this software for any purpose with or without fee is hereby granted. the software is provided"),
    ("zlib", 0.9, "the origin of this software must not be misrepresented"),
    ("zlib", 0.9, "altered source versions must be plainly marked as such"),
    ("zlib", 0.8, "this notice may not be removed or altered from any source distribution"),
    ("boost", 0.9, "machine-executable object code generated by a source language processor"),
    ("unlicense", 0.9, "anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("unlicense", 0.9, "we dedicate any and all copyright interest in the software to the public domain"),
    ("cc0", 0.9, "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", 0.9, "to the extent possible under law, the author has waived all copyright and related or neighboring rights"),
    ("cc-by", 0.7, "you must give appropriate credit, provide a link to the license, and indicate if changes were made"),
    ("cc-by-sa", 0.7, "you must distribute your contributions under the same license as the original"),
    ("cc-by-nc", 0.6, "you may not use the material for commercial purposes"),
    ("cc-by-nd", 0.6, "you may not distribute the modified material"),
    ("artistic", 0.9, "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic", 0.8, "under the same terms as perl itself"),
    ("python", 0.9, "this license agreement is between the python software foundation"),
    ("python", 0.9, "psf is making python available to licensee"),
    ("python", 0.9, "beopen python open source license agreement"),
    ("php", 0.9, "this product includes php software, freely available from"),
    ("openssl", 0.9, "this product includes software developed by the openssl project"),
    ("openssl", 0.8, "this product includes cryptographic software written by"),
    ("libpng", 0.9, "this copy of the libpng notices is provided for your convenience"),
    ("ijg", 0.9, "this software is based in part on the work of the independent jpeg group"),
    ("ftl", 0.9, "portions of this software are copyright the freetype project"),
    ("ncsa", 0.9, "to deal with the software without restriction, including without limitation the rights to use"),
    ("json", 0.9, "the software shall be used for good, not evil"),
    ("beerware", 0.9, "if we meet some day, and you think this stuff is worth it, you can buy me a beer in return: license"),
    ("ruby", 0.9, "you may make and give away verbatim copies of the source form of the software without restriction"),
    ("sleepycat", 0.9, "redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("ofl", 0.9, "this font software is licensed under the sil open font license"),
    ("ofl", 0.8, "no modified version of the font software may use the reserved font name"),
    ("gfdl", 0.9, "permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation"),
    ("lppl", 0.9, "distributed and/or modified under the conditions of the latex project public license"),
    ("ms-pl", 0.8, "this license governs use of the accompanying software. if you use the software, you accept this license"),
    ("cecill", 0.9, "this software is governed by the cecill"),
    ("eupl", 0.8, "this european union public licence applies to the work"),
    ("sspl", 0.9, "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("busl", 0.8, "is not an open source license. however, the licensed work will eventually be made available"),
    ("elastic", 0.8, "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", 0.9, "commons clause license condition"),
    ("odbl", 0.8, "any rights in individual contents of the database are licensed under the database contents license"),
    ("cdla", 0.9, "community data license agreement"),
    ("ogl", 0.9, "contains public sector information licensed under the open government licence"),
    ("openrail", 0.9, "creativeml open rail-m license"),
    ("public-domain", 0.7, "not subject to copyright protection in the united states"),
    ("proprietary", 0.9, "unauthorized copying of this file, via any medium"),
    ("proprietary", 0.9, "this software is the confidential and proprietary information of"),
    ("proprietary", 0.7, "no part of this publication may be reproduced, stored in a retrieval system, or transmitted without permission"),
    ("eula", 0.8, "by installing or using the software, you agree to be bound by the terms of this license"),
    ("unknown", 0.5, "licensed under the terms and conditions of the license agreement"),
    ("unknown", 0.5, "is dual licensed under"),
    ("unknown", 0.5, "is available under a dual license"),
)
#: Label, confidence, expression, gate, keyword; short names, headings, package metadata, badges and places.
NAMED = (
    ("gpl", 0.9, r"GNU\s+GENERAL\s+PUBLIC\s+LICENSE\s+Version\s+[123],", "licen", "general public license version"),
    ("lgpl", 0.9, r"GNU\s+(?:LESSER|LIBRARY)\s+GENERAL\s+PUBLIC\s+LICENSE\s+Version\s+[23]", "licen", "general public license version"),
    ("agpl", 0.9, r"GNU\s+AFFERO\s+GENERAL\s+PUBLIC\s+LICENSE\s+Version\s+3,", "licen", "affero general public license version"),
    ("apache", 0.9, r"Apache\s+License\s+Version\s+2\.0,\s+January\s+2004", "licen", "apache license version"),
    ("apache", 0.9, r"Apache\s+License\s+(?:v2\.0\s+)?with\s+LLVM\s+Exceptions?", "licen", "with llvm exception"),
    ("mpl", 0.9, r"Mozilla\s+Public\s+License\s+Version\s+[12]\.[01]\s+=+", "licen", "mozilla public license version"),
    ("cc0", 0.9, r"CC0\s+1\.0\s+Universal\s+\(CC0", "cc0", "1.0 universal"),
    ("gpl", 0.9, r"\bGPL,?\s+version\s+[123](?:\.0)?\s+or\s+(?:any\s+)?later", "gpl", "or "),
    ("gpl", 0.9, r"\bGNU\s+GPL\s+v(?:ersion\s+)?[123]", "gpl", "gnu gpl v"),
    ("lgpl", 0.9, r"\bLGPL,?\s+version\s+(?:2\.1|3)\s+or\s+(?:any\s+)?later", "gpl", "lgpl"),
    ("agpl", 0.9, r"\bAGPL,?\s+version\s+3\s+or\s+(?:any\s+)?later", "gpl", "agpl"),
    ("gpl", 0.8, r"\bGPL[- ]licen[cs]ed\b", "licen", "gpl"),
    ("mit", 0.8, r"\bMIT[- ]licen[cs]ed\b", "licen", "mit"),
    ("bsd", 0.8, r"\bBSD[- ]licen[cs]ed\b", "licen", "bsd"),
    ("isc", 0.8, r"\bISC[- ]licen[cs]ed\b", "licen", "isc"),
    ("apache", 0.8, r"\bApache[- ](?:2(?:\.0)?[- ])?licen[cs]ed\b", "licen", "apache"),
    ("bsd", 0.7, r"\b(?:new|modified|simplified|revised|[234][- ]clause)\s+BSD\b", "bsd", "bsd"),
    ("beerware", 0.9, r"\bTHE\s+BEER-?WARE\s+LICENSE\b", "licen", "the beer"),
    ("polyform", 0.9, r"\bPolyForm\s+(?:Noncommercial|Shield|Small\s+Business|Strict|Perimeter)\s+License\b", "licen", "polyform"),
    ("llama", 0.9, r"\bLlama\s+[234](?:\.\d)?\s+Community\s+License\b", "licen", "llama"),
    ("openrail", 0.8, r"\bBigScience\s+(?:Open\s+)?RAIL(?:-M)?\s+License\b", "licen", "bigscience"),
    ("ogl", 0.8, r"\bOpen\s+Government\s+Licen[cs]e\b", "licen", "open government"),
    ("eula", 0.8, r"\bEND[- ]USER\s+LICEN[CS]E\s+AGREEMENT\b", "licen", "user"),
    ("busl", 0.7, r"\bAdditional\s+Use\s+Grant:\s", "additional use grant", "grant:"),
    ("mit", 0.95, r"License\s+::\s+OSI\s+Approved\s+::\s+MIT\b", "osi approved", ":: mit"),
    ("apache", 0.95, r"License\s+::\s+OSI\s+Approved\s+::\s+Apache\b", "osi approved", ":: apache"),
    ("bsd", 0.95, r"License\s+::\s+OSI\s+Approved\s+::\s+BSD\b", "osi approved", ":: bsd"),
    ("isc", 0.95, r"License\s+::\s+OSI\s+Approved\s+::\s+ISC\b", "osi approved", ":: isc"),
    ("gpl", 0.95, r"License\s+::\s+OSI\s+Approved\s+::\s+GNU\s+General\b", "osi approved", ":: gnu general"),
    ("lgpl", 0.95, r"License\s+::\s+OSI\s+Approved\s+::\s+GNU\s+L(?:esser|ibrary)\b", "osi approved", ":: gnu l"),
    ("agpl", 0.95, r"License\s+::\s+OSI\s+Approved\s+::\s+GNU\s+Affero\b", "osi approved", ":: gnu affero"),
    ("mpl", 0.95, r"License\s+::\s+OSI\s+Approved\s+::\s+Mozilla\b", "osi approved", ":: mozilla"),
    ("python", 0.95, r"License\s+::\s+OSI\s+Approved\s+::\s+Python\b", "osi approved", ":: python"),
    ("mit", 0.9, r""""licen[cs]e"\s*:\s*"MIT\b""", "licen", '"mit'),
    ("isc", 0.9, r""""licen[cs]e"\s*:\s*"ISC\b""", "licen", '"isc'),
    ("apache", 0.9, r""""licen[cs]e"\s*:\s*"Apache[- ]2""", "licen", '"apache'),
    ("bsd", 0.9, r""""licen[cs]e"\s*:\s*"BSD\b""", "licen", '"bsd'),
    ("gpl", 0.9, r""""licen[cs]e"\s*:\s*"GPL\b""", "licen", '"gpl'),
    ("mpl", 0.9, r""""licen[cs]e"\s*:\s*"MPL\b""", "licen", '"mpl'),
    ("mit", 0.8, r"shields\.io/badge/licen[cs]e-MIT", "licen", "e-mit"),
    ("apache", 0.8, r"shields\.io/badge/licen[cs]e-Apache", "licen", "e-apache"),
    ("gpl", 0.8, r"shields\.io/badge/licen[cs]e-GPL", "licen", "e-gpl"),
    ("bsd", 0.8, r"shields\.io/badge/licen[cs]e-BSD", "licen", "e-bsd"),
    ("mit", 0.9, r"choosealicense\.com/licenses/mit\b", "choosealicense.com", "/mit"),
    ("apache", 0.9, r"choosealicense\.com/licenses/apache\b", "choosealicense.com", "/apache"),
    ("gpl", 0.9, r"choosealicense\.com/licenses/gpl\b", "choosealicense.com", "/gpl"),
    ("mit", 0.9, r"spdx\.org/licenses/MIT\b", "spdx.org", "/mit"),
    ("apache", 0.9, r"spdx\.org/licenses/Apache-", "spdx.org", "/apache-"),
    ("gpl", 0.9, r"spdx\.org/licenses/GPL-", "spdx.org", "/gpl-"),
    ("lgpl", 0.9, r"spdx\.org/licenses/LGPL-", "spdx.org", "/lgpl-"),
    ("bsd", 0.9, r"spdx\.org/licenses/BSD-", "spdx.org", "/bsd-"),
)
#: Words that many rules share, as gates of phrases: the first that a phrase holds is its gate.
_GATES = (
    "licen", "copyright notice", "warrant", "redistribut", "public domain", "permission", "copyright", "free software",
    "this software", "the software", "this program", "this product", "the program", "this library", "the material",
    "object code", "altered source", "perl itself", "special exception", "bison", "source code", "verbatim copies",
    "terms of", "python", "cddl", "package may be", "prominently offer", "hosted or managed", "publication may be",
    "unauthorized copying", "no modified version", "your contributions", "the mpl", "this notice", "modified material", "libpng",
)


@dataclass(frozen=True)
class Rule:
    """tier: 1 for declarations and texts, 2 for notices and places, 3 for names, 4 for general words.

    pattern says what the rule finds in a text. declared: the same within a line after SPDX-License-Identifier:, where a
    rule of that kind is looked for instead, so that lines may be of any length.
    """

    tier: int
    label: str
    confidence: float
    pattern: str
    gate: str
    keyword: str
    declared: str | None = None


_DECLARATION = r"(?i)SPDX-License-Identifier:[^\n]*"


def rules() -> list[Rule]:
    """All rules in order: for each name its declaration, its notice and the name alone, and then the others."""
    notice = (
        r"(?:licen[cs]ed|released|distributed|available|provided|published|covered|shared)\s+under\s+(?:an?\s+|the\s+)?"
        r"(?:terms\s+(?:and\s+conditions\s+)?of\s+(?:the\s+)?)?"
    )
    out = []
    for label, spdx, name, gate, keyword in FAMILIES:
        inner = rf"(?i)(?<![\w.+-]){spdx}(?![\w.+-])"
        whole = rf"(?i)(?<=SPDX-License-Identifier:[^\n]*)(?<![\w.+-]){spdx}(?![\w.+-])"
        out.append(Rule(1, label, 1.0, whole, "spdx-", "license-identifier", inner))
        out.append(Rule(2, label, 0.95, rf"(?i)\b{notice}{name}", gate, keyword))
        out.append(Rule(3, label, 0.8, rf"(?i)\b{name}(?!\w)", gate, keyword))
    said = [(a, b, r"\s+".join(map(re.escape, c.split())), next(g for g in _GATES if g in c), c) for a, b, c in PHRASED]
    for label, confidence, pattern, gate, keyword in (*OTHERS, *NAMED, *said):
        tier = 2 if confidence >= 0.9 else 3 if confidence > 0.5 else 4
        out.append(Rule(tier, label, confidence, rf"(?i){pattern}", gate, keyword))
    return out


def n_words(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of text in lower case; its case doesn't matter to their number."""
    edge = lambda at: F.substring(text, at, 1).rlike(SEPARATOR).cast("int")
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, f"{SEPARATOR}+", -1)) - edge(1) - edge(-1)).cast("long")


def _phrase(words: str) -> str:
    return rf"(?i)(?<!{_WORD})" + rf"{SEPARATOR}+".join(words.split()) + rf"(?!{_WORD})"


def _base(text: Column) -> dict[str, Column]:
    """n_base, first_word, last_word and base_labels, from what stands between a phrase's places."""
    has, gate = {}, F.contains(F.lower(text), F.lit("license"))
    for words, label in PHRASES.items():
        parts = F.split(text, _phrase(words), -1)
        n = F.size(parts) - 1
        has[label] = (n, F.when(n > 0, n_words(F.element_at(parts, 1))), F.when(n > 0, n_words(text) - n_words(F.element_at(parts, -1)) - len(words.split())))
    labels = F.concat_ws(",", *[F.when(n > 0, F.lit(label)) for label, (n, _, _) in sorted(has.items())])
    return {
        "n_base": F.when(gate, sum((n for n, _, _ in has.values()), F.lit(0))).otherwise(0).cast("long"),
        "first_word": F.when(gate, F.least(*[a for _, a, _ in has.values()])).cast("long"),
        "last_word": F.when(gate, F.greatest(*[b for _, _, b in has.values()])).cast("long"),
        "base_labels": F.when(gate, labels).otherwise(""),
    }


def _holds(low: Column, gate: str) -> Column:
    """Whether low holds the gate, with any run of blanks for a space."""
    first, *more = gate.split(" ")
    return F.contains(low, F.lit(first)) & low.rlike(r"\s+".join([first, *more])) if more else F.contains(low, F.lit(first))


def _constant(rows: list[dict], schema: str) -> Column:
    """An array of structs as one constant, which takes the planner no time, whatever its size."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")


def _found(signatures: list[tuple[int, Rule]], text: Column, low: Column | None) -> Column:
    """An array of (rule, pattern) for the rules that find something in text, by one pass over a table of all rules.

    low: the text in lower case with single spaces, which a rule's gate and keyword must be in. A plan with an expression
    of its own for each rule takes longer to compile than the rules take to run.
    """
    values = [{"rule": k, "pattern": r.declared or r.pattern, "gate": r.gate, "keyword": r.keyword} for k, r in signatures]
    table = _constant(values, "rule int, pattern string, gate string, keyword string")
    hit = lambda r: F.regexp_like(text, r["pattern"])
    gated = lambda r: F.contains(low, r["keyword"]) & F.contains(low, r["gate"]) & hit(r)
    return F.transform(F.filter(table, hit if low is None else gated), lambda r: F.struct(r["rule"].alias("rule"), r["pattern"].alias("pattern")))


def detections(texts: DataFrame, signatures: list[Rule] | None = None) -> DataFrame:
    """h1, h2, tier, label, confidence, start, end for what the rules find in the different texts of a table (h1, h2, text).

    A text that holds a rule's gate and keyword, its runs of blanks as one space, is a candidate; the rule's expression
    then finds its places, in code points. Declarations are looked for line by line. A find that lies within another of
    the same or a better tier is suppressed; of equal finds the first in the rules' order stays.
    """
    signatures = signatures or rules()
    gates = sorted({r.gate for r in signatures})
    gates = [g for g in gates if not any(o != g and o in g for o in gates)]  # a gate that holds another needs no look
    # The lowered text is an element of an array, so that it is made once for each text and not for each gate.
    some = texts.where(F.exists(F.array(F.lower("text")), lambda low: F.greatest(*[_holds(low, g) for g in gates])))
    # Candidates are few and small beside what is done to each: they are dealt by number, not by bytes.
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), texts.sparkSession.sparkContext.defaultParallelism)
    lowered = some.withColumn("low", F.regexp_replace(F.lower("text"), r"\s+", " ")).dropDuplicates(["h1", "h2"])
    lowered = lowered.repartition(parts, "h1", "h2")
    plain = [(k, r) for k, r in enumerate(signatures) if r.declared is None]
    declared = [(k, r) for k, r in enumerate(signatures) if r.declared is not None]
    whole = F.struct(F.lit(0).alias("base"), F.col("text").alias("text"), _found(plain, F.col("text"), F.col("low")).alias("hits"))
    cut = F.split("text", _DECLARATION, -1)
    lines = F.regexp_extract_all("text", F.lit(_DECLARATION), F.lit(0))
    # Where each line begins: what stands before it, and all lines before it.
    base = lambda i: F.aggregate(
        F.slice(F.arrays_zip(cut.alias("x"), lines.alias("y")), 1, i + 1), F.lit(0), lambda s, p: s + F.length(p["x"]) + F.length(p["y"])
    )
    line = F.transform(lines, lambda x, i: F.struct((base(i) - F.length(x)).alias("base"), x.alias("text")))
    line = F.transform(line, lambda x: F.struct(x["base"].alias("base"), x["text"].alias("text"), _found(declared, x["text"], None).alias("hits")))
    line = F.when(F.contains("low", F.lit("spdx-license-identifier:")), line)
    units = F.concat(F.array(whole), F.coalesce(line, F.array().cast(_UNITS))) if declared else F.array(whole)
    units = lowered.select("h1", "h2", F.explode(units).alias("u")).where(F.size("u.hits") > 0)
    tried = units.select("h1", "h2", "u.base", "u.text", F.explode("u.hits").alias("r")).select("h1", "h2", "base", "text", "r.rule", "r.pattern")
    pieces = F.expr("arrays_zip(split(text, pattern, -1), regexp_extract_all(text, pattern, 0))")
    sizes = F.transform(pieces, lambda p: F.struct(F.length(p["0"]).alias("before"), F.length(p["1"]).alias("size")))
    each = tried.select("h1", "h2", "base", "rule", F.posexplode(sizes).alias("at", "piece"))
    order = Window.partitionBy("h1", "h2", "rule", "base").orderBy("at")
    end = F.sum(F.col("piece.before") + F.coalesce("piece.size", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = [{"tier": r.tier, "label": r.label, "confidence": r.confidence} for r in signatures]
    of = _constant(rows, "tier int, label string, confidence double")
    found = each.withColumn("end", F.col("base") + end).where("piece.size is not null").withColumn("of", F.element_at(of, F.col("rule") + 1))
    found = found.select("h1", "h2", "rule", "of.*", (F.col("end") - F.col("piece.size")).alias("start"), "end")
    before = Window.partitionBy("h1", "h2").orderBy("start", F.desc("end"), "tier", "rule").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.lit(False)
    for tier in (1, 2, 3, 4):
        reach = F.max(F.when(F.col("tier") <= tier, F.col("end"))).over(before)
        inside = inside | ((F.col("tier") == tier) & F.coalesce(reach >= F.col("end"), F.lit(False)))
    return found.withColumn("inside", inside).where(~F.col("inside")).drop("inside", "rule")


_UNITS = "array<struct<base:int,text:string,hits:array<struct<rule:int,pattern:string>>>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for each row of docs.

    labels are the base ones and those of detections that aren't suppressed, distinct and sorted; score is the best
    confidence among them (a base label has 0.9), 0 for none. What is found depends on the text alone, so equal texts
    are looked at once, and found by two hashes of the text. A null or empty text has no words and no labels; a very long
    one is looked at whole; repeated rows and rows with a null doc_id each give theirs; other columns, whatever their
    names, are left out; an empty table gives none.
    """
    h1, h2 = digest("text")
    rows = text_or_empty(docs).select("doc_id", "text", h1.alias("h1"), h2.alias("h2"))
    found = detections(rows.select("h1", "h2", "text")).groupBy("h1", "h2").agg(F.collect_set("label").alias("more"), F.max("confidence").alias("best"))
    found = settled(found, "licenses")  # a plain exchange on both sides of the join lets Spark split a large group of copies
    base = rows.select("doc_id", "h1", "h2", n_words(F.col("text")).alias("n_words"), *[c.alias(k) for k, c in _base(F.col("text")).items()])
    own = F.filter(F.split("base_labels", ","), lambda x: x != "")
    every = F.array_sort(F.array_distinct(F.concat(own, F.coalesce("more", F.array().cast("array<string>")))))
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(0.9)).otherwise(0.0))
    return base.join(found, ["h1", "h2"], "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", F.concat_ws(",", every).alias("labels"), score.alias("score")
    )
