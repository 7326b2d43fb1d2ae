"""The signature rules of the license scan, in order.

One rule a line: license, priority, keywords, pattern. A rule is tried only where
every one of its keywords occurs (``|`` between alternatives of one keyword), so
every string that the pattern accepts must contain them. In
a pattern a space stands for any white space, with comment marks at line starts.
Priorities: 90 identifiers and whole names with versions, 80 license sentences,
70 titles and notices, 60 addresses, 50 short names, 40 mere hints.
"""

RULES = r"""
Apache-2.0 | 90 | spdx apache-2.0 | SPDX-License-Identifier: \(?Apache-2\.0\b
Apache-2.0 | 80 | licensed apache | licensed under the Apache License,? \(?Version 2(?:\.0)?\b
Apache-2.0 | 80 | released|available|distributed apache | (?:released|available|distributed) under (?:the )?Apache (?:License,? )?(?:Version )?2(?:\.0)?\b
Apache-2.0 | 70 | apache january | Apache License Version 2\.0, January 2004
Apache-2.0 | 70 | apache license | Apache (?:Software )?License,? (?:Version |v\.? ?)?2(?:\.0)?\b
Apache-2.0 | 60 | apache.org/licenses | https?://(?:www\.)?apache\.org/licenses/LICENSE-2\.0(?:\.txt|\.html)?
Apache-2.0 | 60 | opensource.org apache | https?://(?:www\.)?opensource\.org/licenses?/apache-?2(?:\.0)?(?:\.php)?
Apache-2.0 | 50 | apache-2|apache2|alv2|asl | \b(?:Apache-2\.0|Apache2|ALv2|ASL 2\.0)\b
Apache-2.0 | 80 | compliance license | you may not use this file except in compliance with the License
Apache-2.0 | 60 | warranties conditions | on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND
Apache-1.1 | 90 | spdx apache-1.1 | SPDX-License-Identifier: \(?Apache-1\.1\b
Apache-1.1 | 70 | apache license | Apache Software License,? (?:Version )?1\.1\b
Apache-1.0 | 90 | spdx apache-1.0 | SPDX-License-Identifier: \(?Apache-1\.0\b
Apache-1.0 | 70 | apache license | Apache (?:Software )?License,? Version 1\.0\b
Apache | 40 | apache licen | Apache Licen[cs]e\b
Apache | 40 | licensed apache | licensed to the Apache Software Foundation
MIT | 90 | spdx mit | SPDX-License-Identifier: \(?MIT\b(?!-)
MIT | 80 | released mit | released under (?:the )?(?:terms of the )?MIT Licen[cs]e
MIT | 80 | licensed mit | (?:dual-?)?licensed under (?:the )?(?:terms of the )?MIT(?: Licen[cs]e)?\b
MIT | 80 | distributed|available mit | (?:distributed|available) under (?:the )?(?:terms of the )?MIT Licen[cs]e
MIT | 80 | permission hereby granted charge | Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
MIT | 70 | copyright permission notice | The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software
MIT | 60 | noninfringement merchantability | THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT
MIT | 60 | opensource.org mit | https?://(?:www\.)?opensource\.org/licenses?/mit(?:-license)?(?:\.php|\.html)?
MIT | 60 | mit-license.org | https?://(?:www\.)?mit-license\.org
MIT | 70 | mit licen | \b(?:The )?MIT Licen[cs]e(?: \(MIT\))?
MIT | 50 | mit licen | \bMIT[- ]licen[cs]ed\b
MIT | 50 | expat | \bExpat Licen[cs]e\b
MIT-0 | 90 | spdx mit-0 | SPDX-License-Identifier: \(?MIT-0\b
MIT-0 | 80 | mit attribution | MIT No Attribution(?: Licen[cs]e)?
MIT-CMU | 90 | spdx mit-cmu | SPDX-License-Identifier: \(?MIT-CMU\b
X11 | 90 | spdx x11 | SPDX-License-Identifier: \(?X11\b
X11 | 70 | x11 licen | \bX11 Licen[cs]e\b
X11 | 60 | consortium advertising | Except as contained in this notice, the name of the X Consortium shall not be used in advertising
BSD-2-Clause | 90 | spdx bsd-2-clause | SPDX-License-Identifier: \(?BSD-2-Clause\b
BSD-2-Clause | 80 | bsd | \b(?:BSD[- ]2[- ]Clause|2-clause BSD|two-clause BSD|Simplified BSD|FreeBSD) Licen[cs]e\b
BSD-2-Clause | 60 | opensource.org bsd-2 | https?://(?:www\.)?opensource\.org/licenses?/bsd-2-clause
BSD-3-Clause | 90 | spdx bsd-3-clause | SPDX-License-Identifier: \(?BSD-3-Clause\b
BSD-3-Clause | 80 | bsd | \b(?:BSD[- ]3[- ]Clause|3-clause BSD|three-clause BSD|New BSD|Modified BSD|Revised BSD) Licen[cs]e\b
BSD-3-Clause | 70 | endorse promote derived | Neither the name of (?:the )?.{1,80}? nor the names of (?:its|their|the) contributors may be used to endorse or promote products derived from this software
BSD-3-Clause | 60 | opensource.org bsd-3 | https?://(?:www\.)?opensource\.org/licenses?/bsd-3-clause
BSD-3-Clause-Clear | 90 | spdx bsd-3-clause-clear | SPDX-License-Identifier: \(?BSD-3-Clause-Clear\b
BSD-4-Clause | 90 | spdx bsd-4-clause | SPDX-License-Identifier: \(?BSD-4-Clause\b
BSD-4-Clause | 80 | bsd | \b(?:BSD[- ]4[- ]Clause|4-clause BSD|four-clause BSD|Original BSD|Old BSD) Licen[cs]e\b
BSD-4-Clause | 70 | advertising materials acknowledg | All advertising materials mentioning features or use of this software must display the following acknowledge?ment
BSD | 80 | licensed|released|distributed bsd | (?:licensed|released|distributed) under (?:the )?(?:terms of the )?BSD(?:[- ]style)? Licen[cs]e
BSD | 70 | redistribution binary | Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met
BSD | 60 | redistributions copyright | Redistributions of source code must retain the above copyright notice
BSD | 60 | redistributions binary | Redistributions in binary form must reproduce the above copyright notice
BSD | 60 | opensource.org bsd-license | https?://(?:www\.)?opensource\.org/licenses?/bsd-license(?:\.php|\.html)?
BSD | 50 | bsd licen | \bBSD(?:[- ]style)? Licen[cs]e\b
BSD | 40 | bsd-licensed | \bBSD-licensed\b
0BSD | 90 | spdx 0bsd | SPDX-License-Identifier: \(?0BSD\b
0BSD | 70 | bsd zero | \b(?:BSD Zero Clause|Zero-Clause BSD) Licen[cs]e\b
GPL-1.0 | 90 | spdx gpl-1.0 | SPDX-License-Identifier: \(?GPL-1\.0(?:-only|-or-later|\+)?
GPL-1.0 | 70 | gnu general public | GNU General Public Licen[cs]e,? version 1\b
GPL-2.0 | 90 | spdx gpl-2.0 | SPDX-License-Identifier: \(?GPL-2\.0(?:-only)?(?![-+\w])
GPL-2.0-or-later | 90 | spdx gpl-2.0 | SPDX-License-Identifier: \(?GPL-2\.0(?:-or-later|\+)
GPL-2.0 | 80 | gnu general public licen | (?:licensed|released|distributed) under (?:the )?(?:terms of (?:the )?)?GNU General Public Licen[cs]e,? (?:version |v\.? ?)2(?:\.0)?\b
GPL-2.0-or-later | 90 | gnu general public version 2 | GNU General Public Licen[cs]e as published by the Free Software Foundation[;,] either version 2 of the Licen[cs]e,? or \(?at your option\)? any later version
GPL-2.0 | 80 | gnu general public version 2 | GNU General Public Licen[cs]e(?: as published by the Free Software Foundation)?[;,]? version 2(?:\.0)?\b
GPL-2.0 | 70 | gnu public june | GNU GENERAL PUBLIC LICENSE Version 2, June 1991
GPL-2.0 | 60 | gnu.org gpl-2 | https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0(?:\.html|\.txt|\.en\.html)?
GPL-2.0 | 60 | opensource.org gpl-2 | https?://(?:www\.)?opensource\.org/licenses?/gpl-2\.0(?:\.php)?
GPL-2.0 | 50 | gplv2|gpl-2|gpl | \b(?:GPL[- ]?v?2(?:\.0)?|GPLv2)(?![\w.+])
GPL-2.0-or-later | 60 | gplv2+|gpl-2+|gpl-2.0+ | \b(?:GPLv2\+|GPL-2\+|GPL-2\.0\+)
GPL-3.0 | 90 | spdx gpl-3.0 | SPDX-License-Identifier: \(?GPL-3\.0(?:-only)?(?![-+\w])
GPL-3.0-or-later | 90 | spdx gpl-3.0 | SPDX-License-Identifier: \(?GPL-3\.0(?:-or-later|\+)
GPL-3.0 | 90 | licensed gnu general public 3 | This (?:work|program|software|project) is licensed under the GNU General Public Licen[cs]e,? version 3\b
GPL-3.0 | 80 | gnu general public licen 3 | (?:licensed|released|distributed) under (?:the )?(?:terms of (?:the )?)?GNU General Public Licen[cs]e,? (?:version |v\.? ?)3(?:\.0)?\b
GPL-3.0-or-later | 90 | gnu general public version 3 | GNU General Public Licen[cs]e as published by the Free Software Foundation[;,] either version 3 of the Licen[cs]e,? or \(?at your option\)? any later version
GPL-3.0 | 80 | gnu general public version 3 | GNU General Public Licen[cs]e(?: as published by the Free Software Foundation)?[;,]? version 3(?:\.0)?\b
GPL-3.0 | 70 | gnu public june 2007 | GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007
GPL-3.0 | 60 | gnu.org gpl-3 | https?://(?:www\.)?gnu\.org/licenses/gpl-3\.0(?:\.html|\.txt|\.en\.html)?
GPL-3.0 | 60 | opensource.org gpl-3 | https?://(?:www\.)?opensource\.org/licenses?/gpl-3\.0(?:\.php)?
GPL-3.0 | 50 | gplv3|gpl-3|gpl | \b(?:GPL[- ]?v?3(?:\.0)?|GPLv3)(?![\w.+])
GPL-3.0-or-later | 60 | gplv3+|gpl-3+|gpl-3.0+ | \b(?:GPLv3\+|GPL-3\+|GPL-3\.0\+)
GPL | 70 | gnu general public licen | GNU General Public Licen[cs]e\b
GPL | 60 | gnu.org gpl | https?://(?:www\.)?gnu\.org/(?:licenses|copyleft)/gpl(?:\.html|\.txt)?
GPL | 50 | gpl | \b(?:under|of) the GPL\b
GPL | 40 | gpl licen | \bGPL(?:'d)?[- ]licen[cs]ed?\b
GPL-exception | 80 | special exception permission | special exception, the copyright holders of this (?:library|program) give you permission to link
GPL-exception | 80 | classpath exception | \bClasspath[- ]exception(?:-2\.0)?\b
GPL-exception | 80 | gcc runtime exception | GCC Runtime Library Exception
GPL-exception | 80 | autoconf exception | Autoconf[- ](?:configure script )?exception
LGPL-2.0 | 90 | spdx lgpl-2.0 | SPDX-License-Identifier: \(?LGPL-2\.0(?:-only|-or-later|\+)?
LGPL-2.0 | 80 | gnu library general public | GNU Library General Public Licen[cs]e(?:,? version 2(?:\.0)?)?
LGPL-2.1 | 90 | spdx lgpl-2.1 | SPDX-License-Identifier: \(?LGPL-2\.1(?:-only|-or-later|\+)?
LGPL-2.1 | 80 | gnu lesser general public 2.1 | GNU Lesser General Public Licen[cs]e(?: as published by the Free Software Foundation)?[;,]? (?:either )?(?:version |v\.? ?)2\.1\b
LGPL-2.1 | 70 | gnu lesser february | GNU LESSER GENERAL PUBLIC LICENSE Version 2\.1, February 1999
LGPL-2.1 | 60 | gnu.org lgpl-2.1 | https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1(?:\.html|\.txt|\.en\.html)?
LGPL-2.1 | 50 | lgpl | \b(?:LGPL[- ]?v?2\.1|LGPLv2\.1)\b
LGPL-3.0 | 90 | spdx lgpl-3.0 | SPDX-License-Identifier: \(?LGPL-3\.0(?:-only|-or-later|\+)?
LGPL-3.0 | 80 | gnu lesser general public version 3 | GNU Lesser General Public Licen[cs]e(?: as published by the Free Software Foundation)?[;,]? (?:either )?version 3(?:\.0)?\b
LGPL-3.0 | 60 | gnu.org lgpl-3 | https?://(?:www\.)?gnu\.org/licenses/lgpl-3\.0(?:\.html|\.txt|\.en\.html)?
LGPL-3.0 | 50 | lgpl | \b(?:LGPL[- ]?v?3(?:\.0)?|LGPLv3)\b
LGPL | 70 | lesser general public | (?:GNU )?Lesser General Public Licen[cs]e\b
LGPL | 60 | gnu.org lgpl|lesser | https?://(?:www\.)?gnu\.org/(?:licenses|copyleft)/(?:lgpl|lesser)(?:\.html|\.txt)?
LGPL | 50 | lgpl | \bLGPL\b
AGPL-3.0 | 90 | spdx agpl-3.0 | SPDX-License-Identifier: \(?AGPL-3\.0(?:-only|-or-later|\+)?
AGPL-3.0 | 80 | affero general public 3 | GNU Affero General Public Licen[cs]e(?: as published by the Free Software Foundation)?[;,]? (?:either )?version 3(?:\.0)?\b
AGPL-3.0 | 70 | affero november | GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007
AGPL-3.0 | 60 | gnu.org agpl-3 | https?://(?:www\.)?gnu\.org/licenses/agpl-3\.0(?:\.html|\.txt|\.en\.html)?
AGPL-3.0 | 50 | agpl | \b(?:AGPL[- ]?v?3(?:\.0)?|AGPLv3)\b
AGPL | 70 | affero general public | (?:GNU )?Affero General Public Licen[cs]e\b
AGPL | 50 | agpl | \bAGPL\b
FDL-1.1 | 90 | spdx gfdl-1.1 | SPDX-License-Identifier: \(?GFDL-1\.1
FDL-1.2 | 90 | spdx gfdl-1.2 | SPDX-License-Identifier: \(?GFDL-1\.2
FDL-1.2 | 80 | gnu free documentation 1.2 | GNU Free Documentation Licen[cs]e,? Version 1\.2\b
FDL-1.3 | 90 | spdx gfdl-1.3 | SPDX-License-Identifier: \(?GFDL-1\.3
FDL-1.3 | 80 | gnu free documentation 1.3 | GNU Free Documentation Licen[cs]e,? Version 1\.3\b
FDL | 70 | free documentation licen | (?:GNU )?Free Documentation Licen[cs]e\b
FDL | 50 | gfdl | \bGFDL\b
MPL-1.0 | 90 | spdx mpl-1.0 | SPDX-License-Identifier: \(?MPL-1\.0
MPL-1.1 | 90 | spdx mpl-1.1 | SPDX-License-Identifier: \(?MPL-1\.1
MPL-1.1 | 80 | mozilla public 1.1 | Mozilla Public Licen[cs]e,? (?:Version |v\.? ?)1\.1\b
MPL-1.1 | 60 | mozilla.org mpl 1.1 | https?://(?:www\.)?mozilla\.org/(?:MPL/)?MPL[-/]1\.1(?:\.html)?
MPL-2.0 | 90 | spdx mpl-2.0 | SPDX-License-Identifier: \(?MPL-2\.0
MPL-2.0 | 80 | mozilla public subject terms | subject to the terms of the Mozilla Public Licen[cs]e,? v(?:ersion |\. ?)2\.0
MPL-2.0 | 80 | mozilla public 2 | Mozilla Public Licen[cs]e,? (?:Version |v\.? ?)?2(?:\.0)?\b
MPL-2.0 | 60 | mozilla.org mpl 2.0 | https?://(?:www\.)?mozilla\.org/(?:en-US/)?MPL/2\.0/?
MPL | 70 | mozilla public licen | Mozilla Public Licen[cs]e\b
MPL | 50 | mpl | \b(?-i:MPL)(?:-?[12]\.[01])?\b
EPL-1.0 | 90 | spdx epl-1.0 | SPDX-License-Identifier: \(?EPL-1\.0
EPL-1.0 | 80 | eclipse public 1.0 | Eclipse Public Licen[cs]e,? (?:-|Version|v\.?) ?v?1\.0\b
EPL-1.0 | 60 | eclipse.org epl-v10 | https?://(?:www\.)?eclipse\.org/legal/epl-v10(?:\.html)?
EPL-2.0 | 90 | spdx epl-2.0 | SPDX-License-Identifier: \(?EPL-2\.0
EPL-2.0 | 80 | eclipse public 2.0 | Eclipse Public Licen[cs]e,? (?:-|Version|v\.?) ?v?2\.0\b
EPL-2.0 | 60 | eclipse.org epl-2.0 | https?://(?:www\.)?eclipse\.org/legal/epl-2\.0/?
EPL | 70 | eclipse public licen | Eclipse Public Licen[cs]e\b
EDL-1.0 | 80 | eclipse distribution | Eclipse Distribution Licen[cs]e,? (?:-|Version|v\.?) ?v?1\.0\b
CDDL-1.0 | 90 | spdx cddl-1.0 | SPDX-License-Identifier: \(?CDDL-1\.0
CDDL-1.0 | 80 | common development distribution 1.0 | Common Development and Distribution Licen[cs]e,? (?:\(CDDL\),? )?Version 1\.0\b
CDDL-1.1 | 90 | spdx cddl-1.1 | SPDX-License-Identifier: \(?CDDL-1\.1
CDDL-1.1 | 80 | common development distribution 1.1 | Common Development and Distribution Licen[cs]e,? (?:\(CDDL\),? )?Version 1\.1\b
CDDL | 70 | common development distribution licen | Common Development and Distribution Licen[cs]e\b
CDDL | 50 | cddl | \bCDDL\b
CPL-1.0 | 90 | spdx cpl-1.0 | SPDX-License-Identifier: \(?CPL-1\.0
CPL-1.0 | 70 | common public licen | Common Public Licen[cs]e(?:,? (?:-|Version|v\.?) ?v?1\.0)?\b
IPL-1.0 | 90 | spdx ipl-1.0 | SPDX-License-Identifier: \(?IPL-1\.0
IPL-1.0 | 70 | ibm public licen | IBM Public Licen[cs]e(?:,? Version 1\.0)?
CC-BY-1.0 | 80 | cc | \bCC[- ]BY[- ]1\.0\b
CC-BY-2.0 | 80 | cc | \bCC[- ]BY[- ]2\.0\b
CC-BY-2.5 | 80 | cc | \bCC[- ]BY[- ]2\.5\b
CC-BY-3.0 | 80 | cc | \bCC[- ]BY[- ]3\.0\b
CC-BY-3.0 | 70 | creative commons attribution 3.0 | Creative Commons Attribution 3\.0(?: Unported| International)?(?: Licen[cs]e)?
CC-BY-3.0 | 60 | creativecommons.org by | https?://(?:www\.)?creativecommons\.org/licenses/by/3\.0/?
CC-BY-4.0 | 90 | spdx cc-by-4.0 | SPDX-License-Identifier: \(?CC-BY-4\.0
CC-BY-4.0 | 80 | cc | \bCC[- ]BY[- ]4\.0\b
CC-BY-4.0 | 70 | creative commons attribution 4.0 | Creative Commons Attribution 4\.0(?: International)?(?: Public)?(?: Licen[cs]e)?
CC-BY-4.0 | 60 | creativecommons.org by | https?://(?:www\.)?creativecommons\.org/licenses/by/4\.0/?(?:legalcode)?
CC-BY-SA-2.5 | 80 | cc | \bCC[- ]BY[- ]SA[- ]2\.5\b
CC-BY-SA-3.0 | 80 | cc | \bCC[- ]BY[- ]SA[- ]3\.0\b
CC-BY-SA-3.0 | 70 | creative commons sharealike|share 3.0 | Creative Commons Attribution[- ]Share ?Alike 3\.0(?: Unported| International)?(?: Licen[cs]e)?
CC-BY-SA-3.0 | 60 | creativecommons.org by-sa | https?://(?:www\.)?creativecommons\.org/licenses/by-sa/3\.0/?
CC-BY-SA-4.0 | 90 | spdx cc-by-sa-4.0 | SPDX-License-Identifier: \(?CC-BY-SA-4\.0
CC-BY-SA-4.0 | 80 | cc | \bCC[- ]BY[- ]SA[- ]4\.0\b
CC-BY-SA-4.0 | 70 | creative commons sharealike|share 4.0 | Creative Commons Attribution[- ]Share ?Alike 4\.0(?: International)?(?: Licen[cs]e)?
CC-BY-SA-4.0 | 60 | creativecommons.org by-sa | https?://(?:www\.)?creativecommons\.org/licenses/by-sa/4\.0/?(?:legalcode)?
CC-BY-NC-3.0 | 80 | cc | \bCC[- ]BY[- ]NC[- ]3\.0\b
CC-BY-NC-4.0 | 90 | spdx cc-by-nc-4.0 | SPDX-License-Identifier: \(?CC-BY-NC-4\.0
CC-BY-NC-4.0 | 90 | licensed cc nc | licensed under (?:a |the )?CC[- ]BY[- ]NC[- ]4\.0\b
CC-BY-NC-4.0 | 80 | cc | \bCC[- ]BY[- ]NC[- ]4\.0\b
CC-BY-NC-4.0 | 70 | creative commons noncommercial|non 4.0 | Creative Commons Attribution[- ]Non-?Commercial 4\.0(?: International)?(?: Licen[cs]e)?
CC-BY-NC-4.0 | 60 | creativecommons.org by-nc | https?://(?:www\.)?creativecommons\.org/licenses/by-nc/4\.0/?(?:legalcode)?
CC-BY-NC-SA-3.0 | 80 | cc | \bCC[- ]BY[- ]NC[- ]SA[- ]3\.0\b
CC-BY-NC-SA-4.0 | 90 | spdx cc-by-nc-sa-4.0 | SPDX-License-Identifier: \(?CC-BY-NC-SA-4\.0
CC-BY-NC-SA-4.0 | 80 | cc | \bCC[- ]BY[- ]NC[- ]SA[- ]4\.0\b
CC-BY-NC-SA-4.0 | 60 | creativecommons.org by-nc-sa | https?://(?:www\.)?creativecommons\.org/licenses/by-nc-sa/4\.0/?
CC-BY-ND-4.0 | 80 | cc | \bCC[- ]BY[- ]ND[- ]4\.0\b
CC-BY-ND-4.0 | 60 | creativecommons.org by-nd | https?://(?:www\.)?creativecommons\.org/licenses/by-nd/4\.0/?
CC-BY-NC-ND-4.0 | 80 | cc | \bCC[- ]BY[- ]NC[- ]ND[- ]4\.0\b
CC-BY-NC-ND-4.0 | 60 | creativecommons.org by-nc-nd | https?://(?:www\.)?creativecommons\.org/licenses/by-nc-nd/4\.0/?
CC | 60 | licensed cc | licensed under (?:a |the )?CC[- ]BY(?:[- ](?:NC|SA|ND)){0,2}
CC | 50 | creative commons licen | Creative Commons(?: [A-Za-z-]+){0,3} Licen[cs]e\b
CC | 40 | creativecommons.org/licenses | https?://(?:www\.)?creativecommons\.org/licenses/[a-z-]+
CC0-1.0 | 90 | spdx cc0-1.0 | SPDX-License-Identifier: \(?CC0-1\.0
CC0-1.0 | 80 | cc0 | \bCC0(?:[- ]1\.0)?(?: Universal)?\b
CC0-1.0 | 70 | creative commons zero|cc0 | Creative Commons (?:CC0|Zero)(?:,? v?1\.0)?(?: Universal)?
CC0-1.0 | 60 | creativecommons.org/publicdomain/zero | https?://(?:www\.)?creativecommons\.org/publicdomain/zero/1\.0/?
CC-PDM-1.0 | 60 | creativecommons.org/publicdomain/mark | https?://(?:www\.)?creativecommons\.org/publicdomain/mark/1\.0/?
Unlicense | 90 | spdx unlicense | SPDX-License-Identifier: \(?Unlicense
Unlicense | 80 | unencumbered public | This is free and unencumbered software released into the public domain
Unlicense | 60 | unlicense.org | https?://(?:www\.)?unlicense\.org/?
Unlicense | 50 | unlicense | \bThe Unlicense\b
WTFPL | 90 | spdx wtfpl | SPDX-License-Identifier: \(?WTFPL
WTFPL | 80 | want public | DO WHAT THE F\w+ YOU WANT TO PUBLIC LICENSE
WTFPL | 50 | wtfpl | \bWTFPL\b
Public-Domain | 70 | public domain | (?:released|placed|dedicated) (?:in)?to the public domain
Public-Domain | 60 | public domain | (?:is|are) (?:hereby )?in the public domain
Public-Domain | 60 | disclaims copyright | The author disclaims copyright to this source code
ISC | 90 | spdx isc | SPDX-License-Identifier: \(?ISC\b
ISC | 80 | permission distribute hereby | Permission to use, copy, modify,? and/or distribute this software for any purpose with or without fee is hereby granted
ISC | 70 | isc licen | \bISC Licen[cs]e\b
ISC | 60 | opensource.org isc | https?://(?:www\.)?opensource\.org/licenses?/isc(?:-license)?
Zlib | 90 | spdx zlib | SPDX-License-Identifier: \(?Zlib\b
Zlib | 80 | misrepresented origin | The origin of this software must not be misrepresented
Zlib | 70 | zlib licen | \bzlib(?:/libpng)? Licen[cs]e\b
Libpng | 90 | spdx libpng | SPDX-License-Identifier: \(?libpng-?2?
BSL-1.0 | 90 | spdx bsl-1.0 | SPDX-License-Identifier: \(?BSL-1\.0
BSL-1.0 | 80 | boost licen | Boost Software Licen[cs]e(?:,? (?:-|Version)? ?1\.0)?
BSL-1.0 | 60 | boost.org license | https?://(?:www\.)?boost\.org/LICENSE_1_0\.txt
BUSL-1.1 | 90 | spdx busl-1.1 | SPDX-License-Identifier: \(?BUSL-1\.1
BUSL-1.1 | 80 | business source licen | Business Source Licen[cs]e(?:,? (?:Version )?1\.1)?
SSPL-1.0 | 90 | spdx sspl-1.0 | SPDX-License-Identifier: \(?SSPL-1\.0
SSPL-1.0 | 80 | server side public | Server Side Public Licen[cs]e(?:,? (?:Version |v)?1)?
Elastic-2.0 | 90 | spdx elastic-2.0 | SPDX-License-Identifier: \(?Elastic-2\.0
Elastic-2.0 | 80 | elastic licen | Elastic Licen[cs]e(?:,? (?:Version |v)?2\.0)?
PSF-2.0 | 90 | spdx psf-2.0|python-2.0 | SPDX-License-Identifier: \(?(?:PSF|Python)-2\.0
PSF-2.0 | 80 | python|psf foundation|psf licen | (?:Python Software Foundation|PSF) Licen[cs]e(?: Agreement)?(?:,? version 2)?
Artistic-1.0 | 90 | spdx artistic-1.0 | SPDX-License-Identifier: \(?Artistic-1\.0
Artistic-2.0 | 90 | spdx artistic-2.0 | SPDX-License-Identifier: \(?Artistic-2\.0
Artistic-2.0 | 80 | artistic licen | Artistic Licen[cs]e,? (?:version )?2\.0\b
Artistic | 70 | artistic licen | (?:The )?\"?Artistic Licen[cs]e\"?
Perl | 80 | perl terms | under the same terms as Perl(?: itself)?
Ruby | 90 | spdx ruby | SPDX-License-Identifier: \(?Ruby\b
Ruby | 70 | ruby licen | \bRuby(?:'s)? Licen[cs]e\b
PHP-3.01 | 90 | spdx php-3.01 | SPDX-License-Identifier: \(?PHP-3\.01
PHP-3.01 | 80 | php licen | PHP Licen[cs]e,? (?:version )?3\.01\b
PHP-3.0 | 80 | php licen | PHP Licen[cs]e,? (?:version )?3\.0\b
OpenSSL | 90 | spdx openssl | SPDX-License-Identifier: \(?OpenSSL
OpenSSL | 80 | openssl toolkit | This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit
OpenSSL | 70 | openssl licen | \bOpenSSL Licen[cs]e\b
OFL-1.1 | 90 | spdx ofl-1.1 | SPDX-License-Identifier: \(?OFL-1\.1
OFL-1.1 | 80 | open font licen | (?:SIL )?Open Font Licen[cs]e(?:,? Version 1\.1)?
OFL-1.1 | 60 | scripts.sil.org/ofl | https?://scripts\.sil\.org/OFL
ODbL-1.0 | 90 | spdx odbl-1.0 | SPDX-License-Identifier: \(?ODbL-1\.0
ODbL-1.0 | 80 | open database licen | (?:ODC )?Open Database Licen[cs]e(?: \(ODbL\))?(?: v?1\.0)?
ODC-By-1.0 | 80 | open data attribution | Open Data Commons Attribution Licen[cs]e(?: v?1\.0)?
PDDL-1.0 | 80 | public domain dedication | Public Domain Dedication (?:and|&) Licen[cs]e
NCSA | 90 | spdx ncsa | SPDX-License-Identifier: \(?NCSA
NCSA | 70 | illinois ncsa | University of Illinois/NCSA Open Source Licen[cs]e
AFL-3.0 | 90 | spdx afl-3.0 | SPDX-License-Identifier: \(?AFL-3\.0
AFL-3.0 | 70 | academic free licen | Academic Free Licen[cs]e(?:,? (?:version |v\.? ?)3\.0)?
OSL-3.0 | 90 | spdx osl-3.0 | SPDX-License-Identifier: \(?OSL-3\.0
OSL-3.0 | 70 | open software licen | Open Software Licen[cs]e(?:,? (?:version |v\.? ?)3\.0)?
EUPL-1.1 | 80 | european union public 1.1 | European Union Public Licen[cs]e,? (?:version |v\.? ?)1\.1\b
EUPL-1.2 | 90 | spdx eupl-1.2 | SPDX-License-Identifier: \(?EUPL-1\.2
EUPL-1.2 | 80 | european union public 1.2 | European Union Public Licen[cs]e,? (?:version |v\.? ?)1\.2\b
EUPL | 70 | european union public licen | European Union Public Licen[cs]e\b
CeCILL-2.1 | 90 | spdx cecill | SPDX-License-Identifier: \(?CECILL-2\.1
CeCILL | 70 | cecill | \bCeCILL(?:-[BC])?(?: v?\d(?:\.\d)?)?\b
MS-PL | 90 | spdx ms-pl | SPDX-License-Identifier: \(?MS-PL
MS-PL | 80 | microsoft public licen | Microsoft Public Licen[cs]e(?: \(Ms-PL\))?
MS-RL | 80 | microsoft reciprocal licen | Microsoft Reciprocal Licen[cs]e(?: \(Ms-RL\))?
APSL-2.0 | 80 | apple public source | Apple Public Source Licen[cs]e(?:,? (?:version )?2\.0)?
NPL-1.1 | 80 | netscape public licen | Netscape Public Licen[cs]e(?:,? (?:version )?1\.[01])?
W3C | 90 | spdx w3c | SPDX-License-Identifier: \(?W3C
W3C | 70 | w3c software notice | W3C Software (?:and Document )?Notice and Licen[cs]e
Unicode-DFS | 90 | spdx unicode | SPDX-License-Identifier: \(?Unicode-(?:DFS-201[56]|3\.0)
Unicode-DFS | 70 | unicode inc licen agreement | Unicode,? Inc\.? Licen[cs]e Agreement
ICU | 70 | icu licen | \bICU Licen[cs]e\b
curl | 90 | spdx curl | SPDX-License-Identifier: \(?curl
PostgreSQL | 90 | spdx postgresql | SPDX-License-Identifier: \(?PostgreSQL
PostgreSQL | 70 | postgresql licen | \bPostgreSQL Licen[cs]e\b
HPND | 80 | permission documentation purpose | Permission to use, copy, modify,? and distribute this software and its documentation for any purpose
IJG | 70 | independent jpeg | This software is based in part on the work of the Independent JPEG Group
FTL | 70 | freetype licen | (?:The )?FreeType (?:Project )?Licen[cs]e
Vim | 70 | vim licen | \bVim Licen[cs]e\b
TCL | 70 | tcl licen | \bTcl/Tk Licen[cs]e\b
JSON | 80 | software good evil | The Software shall be used for Good, not Evil
Beerware | 80 | retain notice stuff | As long as you retain this notice you can do whatever you want with this stuff
Beerware | 50 | beer-ware|beerware | \bBEER-?WARE LICENSE\b
UPL-1.0 | 90 | spdx upl-1.0 | SPDX-License-Identifier: \(?UPL-1\.0
UPL-1.0 | 80 | universal permissive licen | Universal Permissive Licen[cs]e(?: \(UPL\))?(?:,? (?:Version |v)?1\.0)?
BlueOak-1.0.0 | 80 | blue oak | Blue Oak Model Licen[cs]e(?: 1\.0\.0)?
MulanPSL-2.0 | 80 | mulan psl | Mulan PSL v2
Hippocratic-2.1 | 80 | hippocratic licen | Hippocratic Licen[cs]e(?: (?:Version |v)?2\.1)?
Parity-7.0.0 | 80 | parity licen | Parity Public Licen[cs]e(?: 7\.0\.0)?
PolyForm | 80 | polyform licen | PolyForm (?:Noncommercial|Small Business|Shield|Perimeter|Strict|Free Trial|Internal Use) Licen[cs]e(?: 1\.0\.[01])?
OpenRAIL | 80 | openrail|rail licen | \b(?:CreativeML )?Open(?: ?RAIL)(?:-[MS]+|\+\+)?(?:-M)? Licen[cs]e\b
Llama | 80 | llama community licen | Llama \d?(?:\.\d)? ?Community Licen[cs]e(?: Agreement)?
Commons-Clause | 80 | commons clause | \bCommons Clause\b(?: Licen[cs]e Condition)?
Proprietary | 70 | all rights reserved | \bAll rights reserved\b
Proprietary | 70 | proprietary confidential | \bproprietary and confidential\b
Proprietary | 60 | unauthorized copying prohibited | Unauthorized copying of this file,? via any medium,? is strictly prohibited
Proprietary | 60 | end user licen agreement | End[- ]User Licen[cs]e Agreement
Unknown | 40 | spdx licen | SPDX-License-Identifier: \(?[A-Za-z0-9.+-]+
Unknown | 30 | licensed terms | licensed under (?:the )?terms of
Unknown | 30 | see licen details|information|licensing | see (?:the )?(?:accompanying |file )?LICENSE(?:\.txt|\.md)? (?:file )?for (?:more )?(?:details|information|licensing)
Unknown | 20 | licen | (?:licensed|released|distributed) under (?:the |an? )?(?:[A-Z][\w.+-]* ){1,4}Licen[cs]e\b
Unknown | 20 | "license" | "license" ?: ?"[A-Za-z0-9.+ -]+"
"""  # fmt: skip
