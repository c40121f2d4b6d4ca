"""The rules: license, priority, keyword that any match holds (lower case; several: any match holds one), regular expression.

A space in an expression stands for white space and comment marks, a counted dot for so many characters, each run of
white space and comment marks as one. Priorities: 90 SPDX tags, 80 texts that name a
license with its version in full, 70 full names, 60 characteristic clauses, 50 addresses, 40 short names, 20 hints.
"""

_GRANT = r"(?:licen[sc]ed|released|distributed|available|made available|published|provided|covered|governed) (?:under|by) (?:the )?(?:terms of )?(?:the )?"

_SPDX = """0BSD AAL AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0 AGPL-1.0-only AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0
APL-1.0 APSL-2.0 Artistic-1.0 Artistic-1.0-Perl Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear
BSD-4-Clause BSL-1.0 BUSL-1.1 CAL-1.0 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-2.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0
CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-ND-3.0 CC-BY-ND-4.0 CC-BY-SA-2.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CDLA-Permissive-1.0 CDLA-Permissive-2.0
CDLA-Sharing-1.0 CECILL-1.0 CECILL-2.0 CECILL-2.1 CECILL-B CECILL-C CPAL-1.0 CPL-1.0 ECL-2.0 EFL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.0 EUPL-1.1 EUPL-1.2
FTL GFDL-1.1-only GFDL-1.2-only GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-only GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later HPND ICU IJG IPL-1.0 ISC
LGPL-2.0-only LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later LPL-1.02 LPPL-1.3c MirOS MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0
NASA-1.3 NCSA NPL-1.1 ODbL-1.0 ODC-By-1.0 OFL-1.0 OFL-1.1 OpenSSL OSL-1.0 OSL-2.0 OSL-2.1 OSL-3.0 PDDL-1.0 PHP-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0
RPL-1.5 RPSL-1.0 Ruby SISSL Sleepycat SPL-1.0 SSPL-1.0 TCL Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C Watcom-1.0 WTFPL X11 Xnet Zend-2.0 Zlib ZPL-2.0 ZPL-2.1""".split()

RULES: list[tuple[str, int, str | tuple[str, ...], str]] = [
    # named in full, with a version
    ("Apache-2.0", 80, "apache", r"\bapache (?:software )?licen[sc]e,? ?(?:\( ?the \"license\" ?\),? )?(?:version|v\.?) ?2(?:\.0)?\b(?!\.\d)"),
    ("Apache-2.0", 70, "apache", r"\bapache[- ](?:license[- ])?2\.0\b"),
    ("Apache-1.1", 80, "apache", r"\bapache (?:software )?licen[sc]e,? (?:version|v\.?) ?1\.1\b"),
    ("Apache-1.0", 80, "apache", r"\bapache (?:software )?licen[sc]e,? (?:version|v\.?) ?1\.0\b"),
    ("MIT", 80, ("mit license", "mit licence"), _GRANT + r"mit licen[sc]e\b"),
    ("MIT", 70, "mit license", r"\b(?:the )?mit license\b"),
    ("MIT", 70, "mit licence", r"\b(?:the )?mit licence\b"),
    ("MIT", 70, "expat license", r"\bexpat license\b"),
    ("MIT-0", 75, "mit no attribution", r"\bmit no attribution\b"),
    ("GPL-3.0-or-later", 85, "general public", r"\bgnu general public licen[sc]e.{0,80}?(?:either )?version 3(?:\.0)? of the licen[sc]e,? or (?:\(at your option\) )?any later version"),
    ("GPL-2.0-or-later", 85, "general public", r"\bgnu general public licen[sc]e.{0,80}?(?:either )?version 2(?:\.0)? of the licen[sc]e,? or (?:\(at your option\) )?any later version"),
    ("GPL-3.0-only", 80, "general public", r"\bgnu general public licen[sc]e,? (?:version|v\.?) ?3(?:\.0)?\b"),
    ("GPL-2.0-only", 80, "general public", r"\bgnu general public licen[sc]e,? (?:version|v\.?) ?2(?:\.0)?\b"),
    ("GPL-1.0-only", 80, "general public", r"\bgnu general public licen[sc]e,? (?:version|v\.?) ?1(?:\.0)?\b"),
    ("GPL", 65, "general public", r"(?<!affero\s)(?<!lesser\s)(?<!library\s)\bgeneral public licen[sc]e\b"),
    ("LGPL-3.0-only", 82, "lesser general", r"\b(?:gnu )?lesser general public licen[sc]e,? (?:version|v\.?) ?3(?:\.0)?\b"),
    ("LGPL-2.1-only", 82, "lesser general", r"\b(?:gnu )?lesser general public licen[sc]e,? (?:version|v\.?) ?2\.1\b"),
    ("LGPL-2.0-only", 82, "library general", r"\b(?:gnu )?library general public licen[sc]e,? (?:version|v\.?) ?2(?:\.0)?\b"),
    ("LGPL-2.1-or-later", 86, "lesser general", r"\b(?:gnu )?lesser general public licen[sc]e.{0,80}?version 2\.1 of the licen[sc]e,? or (?:\(at your option\) )?any later version"),
    ("LGPL-3.0-or-later", 86, "lesser general", r"\b(?:gnu )?lesser general public licen[sc]e.{0,80}?version 3 of the licen[sc]e,? or (?:\(at your option\) )?any later version"),
    ("LGPL", 70, "lesser general", r"\b(?:gnu )?lesser general public licen[sc]e\b"),
    ("LGPL", 70, "library general", r"\b(?:gnu )?library general public licen[sc]e\b"),
    ("AGPL-3.0-only", 82, "affero", r"\b(?:gnu )?affero general public licen[sc]e,? (?:version|v\.?) ?3(?:\.0)?\b"),
    ("AGPL-3.0-or-later", 86, "affero", r"\b(?:gnu )?affero general public licen[sc]e.{0,80}?version 3 of the licen[sc]e,? or (?:\(at your option\) )?any later version"),
    ("AGPL", 70, "affero", r"\b(?:gnu )?affero general public licen[sc]e\b"),
    ("GFDL-1.3-only", 80, "free documentation", r"\bgnu free documentation licen[sc]e,? (?:version|v\.?) ?1\.3\b"),
    ("GFDL-1.2-only", 80, "free documentation", r"\bgnu free documentation licen[sc]e,? (?:version|v\.?) ?1\.2\b"),
    ("GFDL", 70, "free documentation", r"\b(?:gnu )?free documentation licen[sc]e\b"),
    ("MPL-2.0", 80, "mozilla public", r"\bmozilla public licen[sc]e,? ?(?:version|v\.?)? ?2(?:\.0)?\b"),
    ("MPL-1.1", 80, "mozilla public", r"\bmozilla public licen[sc]e,? ?(?:version|v\.?)? ?1\.1\b"),
    ("MPL-1.0", 80, "mozilla public", r"\bmozilla public licen[sc]e,? ?(?:version|v\.?)? ?1\.0\b"),
    ("MPL", 65, "mozilla public", r"\bmozilla public licen[sc]e\b"),
    ("EPL-2.0", 80, "eclipse public", r"\beclipse public licen[sc]e,? ?(?:-|version|v\.?)? ?2(?:\.0)?\b"),
    ("EPL-1.0", 80, "eclipse public", r"\beclipse public licen[sc]e,? ?(?:-|version|v\.?)? ?1(?:\.0)?\b"),
    ("EPL", 65, "eclipse public", r"\beclipse public licen[sc]e\b"),
    ("CDDL-1.1", 80, "common development", r"\bcommon development and distribution licen[sc]e.{0,20}?1\.1\b"),
    ("CDDL-1.0", 80, "common development", r"\bcommon development and distribution licen[sc]e.{0,20}?1\.0\b"),
    ("CDDL", 65, "common development", r"\bcommon development and distribution licen[sc]e\b"),
    ("EUPL-1.2", 80, "european union public", r"\beuropean union public licen[sc]e,? (?:version|v\.?) ?1\.2\b"),
    ("EUPL-1.1", 80, "european union public", r"\beuropean union public licen[sc]e,? (?:version|v\.?) ?1\.1\b"),
    ("EUPL", 65, "european union public", r"\beuropean union public licen[sc]e\b"),
    ("Artistic-2.0", 80, "artistic license", r"\bartistic license,? (?:version )?2\.0\b"),
    ("Artistic-1.0", 80, "artistic license", r"\bartistic license,? (?:version )?1\.0\b"),
    ("Artistic", 65, "artistic license", r"\bartistic license\b"),
    ("AFL-3.0", 80, "academic free", r"\bacademic free licen[sc]e,? (?:version|v\.?) ?3\.0\b"),
    ("AFL-2.1", 80, "academic free", r"\bacademic free licen[sc]e,? (?:version|v\.?) ?2\.1\b"),
    ("OSL-3.0", 80, "open software license", r"\bopen software license,? (?:version|v\.?)? ?3\.0\b"),
    ("BSL-1.0", 80, "boost software", r"\bboost software licen[sc]e\b(?:,? ?-? ?version 1\.0)?"),
    ("BUSL-1.1", 80, "business source", r"\bbusiness source licen[sc]e\b(?: 1\.1)?"),
    ("SSPL-1.0", 80, "server side public", r"\bserver side public licen[sc]e\b"),
    ("Elastic-2.0", 80, "elastic license", r"\belastic license(?: 2\.0)?\b"),
    ("UPL-1.0", 80, "universal permissive", r"\buniversal permissive licen[sc]e\b"),
    ("BlueOak-1.0.0", 80, "blue oak", r"\bblue oak model licen[sc]e\b"),
    ("MulanPSL-2.0", 80, "mulan", r"\bmulan (?:permissive software licen[sc]e|psl),? ?v2\b"),
    ("MS-PL", 80, "microsoft public", r"\bmicrosoft public licen[sc]e\b"),
    ("MS-RL", 80, "microsoft reciprocal", r"\bmicrosoft reciprocal licen[sc]e\b"),
    ("CECILL-2.1", 80, "cecill", r"\bcecill(?: free software)?(?: licen[sc]e)?(?: agreement)?,? (?:version|v\.?) ?2\.1\b"),
    ("CECILL-B", 75, "cecill-b", r"\bcecill-b\b"),
    ("CECILL-C", 75, "cecill-c", r"\bcecill-c\b"),
    ("CPL-1.0", 80, "common public license", r"\bcommon public license\b(?:,? ?-? ?v(?:ersion)? ?1\.0)?"),
    ("IPL-1.0", 80, "ibm public license", r"\bibm public license\b"),
    ("CPAL-1.0", 80, "common public attribution", r"\bcommon public attribution licen[sc]e\b"),
    ("ECL-2.0", 80, "educational community", r"\beducational community licen[sc]e\b"),
    ("NCSA", 80, "ncsa", r"\b(?:university of illinois/)?ncsa open source licen[sc]e\b"),
    ("OFL-1.1", 80, "open font", r"\bsil open font licen[sc]e\b(?:,? version 1\.1)?"),
    ("PostgreSQL", 75, "postgresql licen", r"\bpostgresql licen[sc]e\b"),
    ("Python-2.0", 75, ("python software foundation", "psf licen"), r"\b(?:python software foundation|psf) licen[sc]e\b(?: version 2)?"),
    ("PHP-3.01", 75, "php license", r"\bphp license,? (?:version )?3\.01\b"),
    ("PHP", 65, "php license", r"\bphp license\b"),
    ("Ruby", 65, "ruby license", r"\bruby license\b"),
    ("Vim", 65, "vim license", r"\bvim license\b"),
    ("Zlib", 75, "zlib", r"\bzlib(?:/libpng)? licen[sc]e\b"),
    ("libpng", 70, "libpng", r"\blibpng licen[sc]e\b"),
    ("ISC", 75, "isc licen", r"\bisc licen[sc]e\b"),
    ("Unlicense", 75, "unlicense", r"\bthe unlicense\b"),
    ("WTFPL", 80, "what the fuck", r"\bdo what the fuck you want to public licen[sc]e\b"),
    ("OpenSSL", 75, "openssl licen", r"\bopenssl licen[sc]e\b"),
    ("SSLeay", 75, "ssleay", r"\boriginal ssleay licen[sc]e\b"),
    ("FTL", 75, "freetype", r"\bfreetype (?:project )?licen[sc]e\b"),
    ("LPPL-1.3c", 80, "latex project", r"\blatex project public licen[sc]e\b(?:,? (?:version )?1\.3c?)?"),
    ("QPL-1.0", 75, "q public", r"\bq public licen[sc]e\b"),
    ("Sleepycat", 75, "sleepycat", r"\bsleepycat licen[sc]e\b"),
    ("SISSL", 75, "sun industry", r"\bsun industry standards source licen[sc]e\b"),
    ("W3C", 75, "w3c", r"\bw3c (?:software )?(?:notice and )?licen[sc]e\b"),
    ("Watcom-1.0", 75, "watcom", r"\bsybase open watcom public licen[sc]e\b"),
    ("ZPL-2.1", 80, "zope public", r"\bzope public licen[sc]e,? ?\(?(?:zpl\)? )?(?:version )?2\.1\b"),
    ("ZPL", 65, "zope public", r"\bzope public licen[sc]e\b"),
    ("APSL-2.0", 80, "apple public source", r"\bapple public source licen[sc]e\b(?:,? version 2\.0)?"),
    ("RPL-1.5", 80, "reciprocal public", r"\breciprocal public licen[sc]e\b(?:,? (?:version )?1\.5)?"),
    ("NASA-1.3", 80, "nasa open source", r"\bnasa open source agreement\b"),
    ("HPND", 80, "historical permission", r"\bhistorical permission notice and disclaimer\b"),
    ("ODbL-1.0", 80, "open database", r"\bopen database licen[sc]e\b(?: ?\(odbl\))?(?: v?1\.0)?"),
    ("ODC-By-1.0", 80, "open data commons", r"\bopen data commons attribution licen[sc]e\b"),
    ("PDDL-1.0", 80, "public domain dedication", r"\bopen data commons public domain dedication\b"),
    ("CDLA-Permissive-2.0", 80, "community data", r"\bcommunity data licen[sc]e agreement ?[-–]? ?permissive,? ?-? ?(?:version )?2\.0\b"),
    ("CDLA-Sharing-1.0", 80, "community data", r"\bcommunity data licen[sc]e agreement ?[-–]? ?sharing\b"),
    ("OpenRAIL", 75, ("openrail", "open rail"), r"\b(?:creativeml |bigscience )?open ?rail(?:[-+]{1,2}m)?(?: licen[sc]e)?\b"),
    ("OGL-UK-3.0", 80, "open government", r"\bopen government licen[sc]e,? ?(?:version|v\.?)? ?3(?:\.0)?\b"),
    ("OGL", 65, "open government", r"\bopen government licen[sc]e\b"),
    ("BSD-4-Clause", 80, "bsd", r"\b(?:4|four)[- ]clause bsd(?: licen[sc]e)?\b"),
    ("BSD-3-Clause", 80, "bsd", r"\b(?:3|three)[- ]clause bsd(?: licen[sc]e)?\b"),
    ("BSD-2-Clause", 80, "bsd", r"\b(?:2|two)[- ]clause bsd(?: licen[sc]e)?\b"),
    ("BSD-3-Clause", 80, "bsd", r"\bbsd[- ]3[- ]clause(?: licen[sc]e)?\b"),
    ("BSD-2-Clause", 80, "bsd", r"\bbsd[- ]2[- ]clause(?: licen[sc]e)?\b"),
    ("BSD-4-Clause", 80, "bsd", r"\bbsd[- ]4[- ]clause(?: licen[sc]e)?\b"),
    ("BSD-3-Clause", 75, "bsd", r"\b(?:new|modified|revised) bsd licen[sc]e\b"),
    ("BSD-2-Clause", 75, "bsd", r"\b(?:simplified|freebsd) bsd licen[sc]e\b"),
    ("0BSD", 75, "bsd", r"\b(?:zero[- ]clause|0-clause) bsd(?: licen[sc]e)?\b"),
    ("BSD", 65, "bsd", r"\bbsd(?:-style)? licen[sc]e\b"),
    # Creative Commons
    ("CC0-1.0", 80, "cc0", r"\bcc0(?:[- ]1\.0)?(?: universal)?\b"),
    ("CC0-1.0", 80, "creative commons", r"\bcreative commons (?:cc0|zero|public domain dedication)\b"),
    ("CC-BY-NC-ND-4.0", 84, "by-nc-nd", r"\bcc[- ]by-nc-nd[- ]4\.0\b"), ("CC-BY-NC-ND-3.0", 84, "by-nc-nd", r"\bcc[- ]by-nc-nd[- ]3\.0\b"),
    ("CC-BY-NC-ND", 72, "by-nc-nd", r"\bcc[- ]by-nc-nd\b"),
    ("CC-BY-NC-SA-4.0", 84, "by-nc-sa", r"\bcc[- ]by-nc-sa[- ]4\.0\b"), ("CC-BY-NC-SA-3.0", 84, "by-nc-sa", r"\bcc[- ]by-nc-sa[- ]3\.0\b"),
    ("CC-BY-NC-SA", 72, "by-nc-sa", r"\bcc[- ]by-nc-sa\b"),
    ("CC-BY-NC-4.0", 82, "by-nc", r"\bcc[- ]by-nc[- ]4\.0\b"), ("CC-BY-NC-3.0", 82, "by-nc", r"\bcc[- ]by-nc[- ]3\.0\b"), ("CC-BY-NC-2.0", 82, "by-nc", r"\bcc[- ]by-nc[- ]2\.0\b"),
    ("CC-BY-NC", 70, "by-nc", r"\bcc[- ]by-nc\b"),
    ("CC-BY-SA-4.0", 82, "by-sa", r"\bcc[- ]by-sa[- ]4\.0\b"), ("CC-BY-SA-3.0", 82, "by-sa", r"\bcc[- ]by-sa[- ]3\.0\b"), ("CC-BY-SA-2.0", 82, "by-sa", r"\bcc[- ]by-sa[- ]2\.0\b"),
    ("CC-BY-SA", 70, "by-sa", r"\bcc[- ]by-sa\b"),
    ("CC-BY-ND-4.0", 82, "by-nd", r"\bcc[- ]by-nd[- ]4\.0\b"), ("CC-BY-ND", 70, "by-nd", r"\bcc[- ]by-nd\b"),
    ("CC-BY-4.0", 80, "cc", r"\bcc[- ]by[- ]4\.0\b"), ("CC-BY-3.0", 80, "cc", r"\bcc[- ]by[- ]3\.0\b"), ("CC-BY-2.0", 80, "cc", r"\bcc[- ]by[- ]2\.0\b"),
    ("CC-BY-NC-ND-4.0", 86, "noncommercial-noderiv", r"\bcreative commons attribution-noncommercial-noderiv(?:ative)?s 4\.0\b"),
    ("CC-BY-NC-SA-4.0", 86, "noncommercial-sharealike", r"\bcreative commons attribution-noncommercial-sharealike 4\.0\b"),
    ("CC-BY-NC-4.0", 84, "attribution-noncommercial", r"\bcreative commons attribution-noncommercial 4\.0\b"),
    ("CC-BY-SA-4.0", 84, ("attribution-sharealike", "attribution-share-alike"), r"\bcreative commons attribution-share-?alike 4\.0\b"),
    ("CC-BY-SA-3.0", 84, ("attribution-sharealike", "attribution-share-alike"), r"\bcreative commons attribution-share-?alike 3\.0\b"),
    ("CC-BY-4.0", 82, "commons attribution", r"\bcreative commons attribution 4\.0\b"), ("CC-BY-3.0", 82, "commons attribution", r"\bcreative commons attribution 3\.0\b"),
    ("CC", 60, "creative commons", r"\bcreative commons (?:public )?licen[sc]e\b"),
    # addresses
    ("Apache-2.0", 50, "apache.org/licenses", r"https?://(?:www\.)?apache\.org/licenses/license-2\.0(?:\.txt|\.html)?"),
    ("MIT", 50, "opensource.org/licenses", r"https?://(?:www\.)?opensource\.org/licenses/mit(?:-license(?:\.php|\.html)?)?\b"),
    ("BSD-3-Clause", 50, "opensource.org/licenses", r"https?://(?:www\.)?opensource\.org/licenses/bsd-3-clause\b"), ("BSD-2-Clause", 50, "opensource.org/licenses", r"https?://(?:www\.)?opensource\.org/licenses/bsd-2-clause\b"),
    ("ISC", 50, "opensource.org/licenses", r"https?://(?:www\.)?opensource\.org/licenses/isc\b"), ("GPL-3.0-only", 50, "gnu.org/licenses", r"https?://(?:www\.)?gnu\.org/licenses/gpl-3\.0"),
    ("GPL-2.0-only", 50, "gnu.org/licenses", r"https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"), ("LGPL-3.0-only", 50, "gnu.org/licenses", r"https?://(?:www\.)?gnu\.org/licenses/lgpl-3\.0"),
    ("AGPL-3.0-only", 50, "gnu.org/licenses", r"https?://(?:www\.)?gnu\.org/licenses/agpl-3\.0"), ("GPL", 40, "gnu.org/licenses", r"https?://(?:www\.)?gnu\.org/licenses/(?!\w)"),
    ("MPL-2.0", 50, "mozilla.org/mpl", r"https?://(?:www\.)?mozilla\.org/mpl/2\.0"), ("EPL-1.0", 50, "eclipse.org/legal", r"https?://(?:www\.)?eclipse\.org/legal/epl-v10"), ("EPL-2.0", 50, "eclipse.org/legal", r"https?://(?:www\.)?eclipse\.org/legal/epl-(?:v20|2\.0)"),
    ("BSL-1.0", 50, "boost.org/license", r"https?://(?:www\.)?boost\.org/license_1_0\.txt"), ("Unlicense", 50, "unlicense.org", r"https?://(?:www\.)?unlicense\.org"), ("WTFPL", 50, "wtfpl.net", r"https?://(?:www\.)?wtfpl\.net"),
    ("OFL-1.1", 50, "scripts.sil.org", r"https?://scripts\.sil\.org/ofl"), ("CC0-1.0", 50, "creativecommons.org", r"https?://creativecommons\.org/publicdomain/zero/1\.0"),
    ("CC-BY-4.0", 50, "creativecommons.org", r"https?://creativecommons\.org/licenses/by/4\.0"), ("CC-BY-3.0", 50, "creativecommons.org", r"https?://creativecommons\.org/licenses/by/3\.0"),
    ("CC-BY-SA-4.0", 50, "creativecommons.org", r"https?://creativecommons\.org/licenses/by-sa/4\.0"), ("CC-BY-SA-3.0", 50, "creativecommons.org", r"https?://creativecommons\.org/licenses/by-sa/3\.0"),
    ("CC-BY-NC-4.0", 50, "creativecommons.org", r"https?://creativecommons\.org/licenses/by-nc/4\.0"), ("CC-BY-NC-SA-4.0", 50, "creativecommons.org", r"https?://creativecommons\.org/licenses/by-nc-sa/4\.0"),
    ("CC-BY-NC-ND-4.0", 50, "creativecommons.org", r"https?://creativecommons\.org/licenses/by-nc-nd/4\.0"), ("CC-BY-ND-4.0", 50, "creativecommons.org", r"https?://creativecommons\.org/licenses/by-nd/4\.0"),
    # clauses
    ("MIT", 60, "permission is hereby granted", r"\bpermission is hereby granted,? free of charge,? to any person obtaining a copy of this software and associated documentation files\b"),
    ("MIT", 55, "above copyright notice and this permission", r"\bthe above copyright notice and this permission notice shall be included in all copies\b"),
    ("X11", 62, "x consortium", r"\bexcept as contained in this notice,? the name of the x consortium\b"),
    ("ISC", 60, "permission to use, copy", r"\bpermission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted\b"),
    ("BSD-2-Clause", 55, "redistribution and use", r"\bredistribution and use in source and binary forms, with or without modification, are permitted\b"),
    ("BSD-3-Clause", 62, "endorse or promote", r"\bneither the name of .{1,120}? may be used to endorse or promote products\b"),
    ("BSD-4-Clause", 62, "advertising materials", r"\ball advertising materials mentioning features or use of this software must display\b"),
    ("Zlib", 60, "provided 'as-is'", r"\bthis software is provided 'as-is', without any express or implied warranty\b"),
    ("Zlib", 60, "origin of this software", r"\bthe origin of this software must not be misrepresented\b"),
    ("Unlicense", 62, "unencumbered", r"\bfree and unencumbered software released into the public domain\b"),
    ("Public-domain", 50, "public domain", r"\b(?:released|placed|dedicated|is) (?:in|in)?to? ?the public domain\b"),
    ("GPL", 60, "free software", r"\bthis (?:program|library|file) is free software[;:,] you can redistribute it and/or modify\b"),
    ("BSL-1.0", 60, "permission is hereby granted", r"\bpermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software\b"),
    ("NCSA", 62, "deal with the software", r"\bto deal with the software without restriction\b"),
    ("PostgreSQL", 62, "without a written agreement", r"\bwithout fee,? and without a written agreement is hereby granted\b"),
    ("JSON", 62, "good, not evil", r"\bthe software shall be used for good, not evil\b"),
    ("Beerware", 62, "beer", r"\byou can buy me a beer in return\b"),
    ("Apache-2.0", 60, "except in compliance", r"\byou may not use this file except in compliance with the license\b"),
    ("MPL-2.0", 62, "subject to the terms of the mozilla", r"\bthis source code form is subject to the terms of the mozilla public licen[sc]e, ?v\. ?2\.0\b"),
    # short names
    ("GPL-3.0-only", 45, "gpl", r"\b(?:gnu )?gpl(?:[- ]?v\.?|[- ])?3(?:\.0)?\b"), ("GPL-2.0-only", 45, "gpl", r"\b(?:gnu )?gpl(?:[- ]?v\.?|[- ])?2(?:\.0)?\b"),
    ("GPL-3.0-or-later", 46, "gpl", r"\b(?:gnu )?gpl(?:[- ]?v\.?|[- ])?3(?:\.0)?(?:\+| or later)"), ("GPL-2.0-or-later", 46, "gpl", r"\b(?:gnu )?gpl(?:[- ]?v\.?|[- ])?2(?:\.0)?(?:\+| or later)"),
    ("LGPL-3.0-only", 45, "lgpl", r"\blgpl(?:[- ]?v\.?|[- ])?3(?:\.0)?\b"), ("LGPL-2.1-only", 45, "lgpl", r"\blgpl(?:[- ]?v\.?|[- ])?2\.1\b"), ("AGPL-3.0-only", 45, "agpl", r"\bagpl(?:[- ]?v\.?|[- ])?3(?:\.0)?\b"),
    ("GPL", 40, "gpl", r"\b(?:gnu )?gpl\b"), ("LGPL", 40, "lgpl", r"\b(?:gnu )?lgpl\b"), ("AGPL", 40, "agpl", r"\b(?:gnu )?agpl\b"), ("WTFPL", 40, "wtfpl", r"\bwtfpl\b"),
    ("MPL-2.0", 45, "mpl", r"\bmpl[- ]?v?2(?:\.0)?\b"), ("EPL-2.0", 45, "epl", r"\bepl[- ]v?2(?:\.0)?\b"), ("EPL-1.0", 45, "epl", r"\bepl[- ]v?1(?:\.0)?\b"), ("EUPL-1.2", 45, "eupl", r"\beupl[- ]v?1\.2\b"),
    ("ODbL-1.0", 45, "odbl", r"\bodbl\b"), ("MIT", 40, "mit", r"\bmit[- ]licensed\b"), ("BSD", 40, "bsd", r"\bbsd[- ]licensed\b"), ("Apache", 40, "apache", r"\bapache[- ]licensed\b"),
    # hints
    ("Proprietary", 55, "all rights reserved", r"\ball rights reserved\b"),
    ("Proprietary", 60, "proprietary", r"\b(?:confidential and proprietary|proprietary and confidential|proprietary licen[sc]e)\b"),
    ("Proprietary", 60, ("may not be copied", "may not be reproduced", "may not be redistributed"), r"\bmay not be (?:copied|reproduced|redistributed).{0,60}?without (?:prior )?(?:written )?permission\b"),
    ("Copyright", 20, "copyright", r"\bcopyright (?:\(c\)|©)? ?(?:19|20)\d\d\b"), ("Copyright", 20, "(c)", r"\(c\) ?(?:19|20)\d\d\b"), ("Copyright", 20, "©", "© ?(?:19|20)\\d\\d\\b"),
    ("Unknown", 20, ("see license", "see licence"), r"\bsee licen[sc]e(?: file| in)?\b"),
]

TAG = "spdx-license-identifier"  # rules of this keyword match within the rest of a line that follows it and a colon
for _id in _SPDX:
    RULES.append((_id, 90, TAG, r"(?<![\w.+-])" + _id.replace(".", r"\.") + r"(?![\w+-])(?!\.\d)"))
