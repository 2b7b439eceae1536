"""Reference tables as plain values. All of them are fixed values: results are only right with exactly these.

Operators take each as a parameter, so a longer table can be given as a DataFrame or dictionary. The outlets' home countries are
such a parameter throughout, since their number grows.
"""

# FIPS 10-4 country codes whose ISO code differs; other codes of two letters are the same in both.
FIPS_TO_ISO = {
    "UK": "GB",
    "GM": "DE",
    "RS": "RU",
    "CH": "CN",
    "SZ": "CH",
    "JA": "JP",
    "EI": "IE",
    "SP": "ES",
    "SF": "ZA",
    "NI": "NG",
    "UP": "UA",
    "KS": "KR",
    "KN": "KP",
    "AS": "AU",
    "PO": "PL",
    "TU": "TR",
    "IS": "IL",
    "IZ": "IQ",
    "SW": "SE",
    "DA": "DK",
    "AU": "AT",
    "BU": "BG",
    "LO": "SK",
    "EZ": "CZ",
    "EN": "EE",
    "LG": "LV",
    "LH": "LT",
    "BO": "BY",
    "SN": "SG",
    "VM": "VN",
    "CB": "KH",
    "BM": "MM",
    "CE": "LK",
    "BG": "BD",
    "CI": "CL",
    "BL": "BO",
    "NU": "NI",
    "HO": "HN",
    "ES": "SV",
    "DR": "DO",
    "HA": "HT",
    "MO": "MA",
    "AG": "DZ",
    "TS": "TN",
    "SU": "SD",
    "CG": "CD",
    "CF": "CG",
    "ZI": "ZW",
    "WA": "NA",
    "BC": "BW",
    "MI": "MW",
    "IV": "CI",
    "NG": "NE",
    "UV": "BF",
    "TO": "TG",
    "BN": "BJ",
    "CT": "CF",
    "CD": "TD",
    "WZ": "SZ",
    "LE": "LS",
    "BY": "BI",
    "SE": "SC",
    "MP": "MU",
    "PU": "GW",
    "GV": "GN",
    "LI": "LR",
}

# Labels of theme codes.
THEME_LABELS = {
    "TAX_TERROR": "Terrorism",
    "ARMEDCONFLICT": "Armed Conflict",
    "CRISISLEX_C03_DEAD_WOUNDED": "Casualties",
    "CRISISLEX_C06_VIOLENCE": "Violence",
    "CRIME": "Crime & Law Enforcement",
    "ARREST": "Arrests",
    "KILL": "Killings",
    "MILITARY": "Military Affairs",
    "SEIZE": "Seizures & Confiscations",
    "CYBERATTACK": "Cyber Attacks",
    "TAX_FNCACT": "Financial Activity",
    "ECON_INFLATION": "Inflation",
    "ECON_TRADE": "International Trade",
    "ECON_BANKRUPTCY": "Bankruptcy",
    "WB_633_ECONOMIC_STABILITY": "Economic Stability",
    "AGRICULTURE": "Agriculture",
    "ENERGY": "Energy",
    "LABOR": "Labor & Employment",
    "STRIKE": "Strikes",
    "LEADER": "Political Leadership",
    "ELECTION": "Elections",
    "GOVERNMENT": "Government Actions",
    "PROTEST": "Protests & Demonstrations",
    "CORRUPTION": "Corruption",
    "TAX_DIPLOMACY": "Diplomacy",
    "WB_632_WOMEN_IN_POLITICS": "Women in Politics",
    "SANCTION": "Sanctions",
    "TREATY": "Treaties & Agreements",
    "COURT": "Legal Proceedings",
    "INVESTIGATION": "Investigations",
    "ENV_CLIMATECHANGE": "Climate Change",
    "ENV_FORESTS": "Deforestation & Forests",
    "ENV_POLLUTION": "Pollution",
    "UNGP_DISASTER": "Natural Disasters",
    "DISASTER_RESPONSE": "Disaster Response",
    "HEALTH": "Public Health",
    "EDUCATION": "Education",
    "HUMAN_RIGHTS": "Human Rights",
    "MIGRATION": "Migration & Refugees",
    "RELIGION": "Religion",
    "SOC_POINTSOFVIEW": "Social Perspectives",
    "MEDIA_MSM": "Mainstream Media",
    "TECHNOLOGY": "Technology",
    "SPACE": "Space Exploration",
    "TRANSPORT": "Transportation",
    "SPORTS": "Sports",
    "ENTERTAINMENT": "Entertainment",
}

# Labels of event codes, of three or four digits.
EVENT_CODE_LABELS = {
    "010": "Make statement",
    "011": "Decline comment",
    "012": "Make pessimistic comment",
    "013": "Make optimistic comment",
    "014": "Consider policy option",
    "015": "Acknowledge or claim responsibility",
    "016": "Reject accusation",
    "017": "Engage in symbolic act",
    "018": "Make empathetic comment",
    "019": "Express accord",
    "020": "Appeal, not specified below",
    "021": "Appeal for material cooperation",
    "0211": "Appeal for economic cooperation",
    "0212": "Appeal for military cooperation",
    "022": "Appeal for diplomatic cooperation",
    "023": "Appeal for aid",
    "024": "Appeal for political reform",
    "025": "Appeal to yield",
    "026": "Appeal to others to meet or negotiate",
    "027": "Appeal to others to settle dispute",
    "028": "Appeal to others to engage in or accept mediation",
    "030": "Express intent to cooperate",
    "031": "Express intent to engage in material cooperation",
    "0311": "Express intent to cooperate economically",
    "0312": "Express intent to cooperate militarily",
    "032": "Express intent to provide diplomatic cooperation",
    "033": "Express intent to provide material aid",
    "034": "Express intent to institute political reform",
    "035": "Express intent to yield",
    "040": "Consult, not specified below",
    "041": "Discuss by telephone",
    "042": "Make a visit",
    "043": "Host a visit",
    "044": "Meet at a 'third' location",
    "045": "Mediate",
    "046": "Engage in negotiation",
    "050": "Engage in diplomatic cooperation",
    "051": "Praise or endorse",
    "052": "Defend verbally",
    "053": "Rally support on behalf of",
    "054": "Grant asylum",
    "055": "Apologize",
    "056": "Forgive",
    "057": "Sign formal agreement",
    "060": "Engage in material cooperation",
    "061": "Cooperate economically",
    "062": "Cooperate militarily",
    "063": "Engage in judicial cooperation",
    "064": "Share intelligence or information",
    "070": "Provide aid, not specified below",
    "071": "Provide economic aid",
    "072": "Provide military aid",
    "073": "Provide humanitarian aid",
    "074": "Provide military protection or peacekeeping",
    "075": "Grant asylum",
    "080": "Yield, not specified below",
    "081": "Ease administrative sanctions",
    "082": "Ease political dissent",
    "083": "Accede to requests or demands",
    "084": "Return, release, not specified below",
    "085": "Surrender territory to",
    "086": "Allow international involvement",
    "087": "De-escalate military engagement",
    "090": "Investigate, not specified below",
    "091": "Investigate crime, corruption",
    "092": "Investigate human rights abuses",
    "093": "Investigate military action",
    "094": "Investigate war crimes",
    "100": "Demand, not specified below",
    "101": "Demand material cooperation",
    "102": "Demand diplomatic cooperation",
    "103": "Demand aid",
    "104": "Demand political reform",
    "105": "Demand that target yields",
    "110": "Disapprove, not specified below",
    "111": "Criticize or denounce",
    "112": "Accuse",
    "113": "Rally opposition against",
    "114": "Complain officially",
    "115": "Bring lawsuit against",
    "116": "Find guilty or condemn",
    "120": "Reject, not specified below",
    "121": "Reject material cooperation",
    "122": "Reject request or demand for material aid",
    "123": "Reject request or demand for political reform",
    "124": "Refuse to yield",
    "125": "Reject proposal to meet, discuss, or negotiate",
    "126": "Reject mediation",
    "127": "Reject plan, agreement to settle dispute",
    "128": "Defy norms, law",
    "129": "Veto",
    "130": "Threaten, not specified below",
    "131": "Threaten non-force",
    "132": "Threaten with administrative sanctions",
    "133": "Threaten with political dissent",
    "134": "Threaten to halt negotiations",
    "135": "Threaten to halt material or economic assistance",
    "136": "Threaten to suspend international relations",
    "137": "Threaten with repression",
    "138": "Threaten to use military force",
    "139": "Give ultimatum",
    "140": "Engage in political dissent",
    "141": "Demonstrate or rally",
    "142": "Conduct strike or boycott",
    "143": "Conduct hunger strike",
    "144": "Obstruct passage, block",
    "145": "Protest violently, riot",
    "150": "Demonstrate military or police power",
    "151": "Increase police alert status",
    "152": "Increase military alert status",
    "153": "Mobilize or exacerbate police power",
    "154": "Mobilize or exacerbate armed forces",
    "160": "Reduce relations, not specified below",
    "161": "Reduce or break diplomatic relations",
    "162": "Reduce or stop material aid",
    "163": "Impose embargo, boycott, or sanctions",
    "164": "Halt negotiations",
    "165": "Halt mediation",
    "166": "Expel or withdraw",
    "170": "Coerce, not specified below",
    "171": "Seize or damage property",
    "172": "Impose administrative sanctions",
    "173": "Arrest, detain, or charge with legal action",
    "174": "Expel or deport individuals",
    "175": "Use tactics of repression",
    "180": "Use unconventional violence",
    "181": "Abduct, hijack, or take hostage",
    "182": "Physically assault",
    "183": "Conduct suicide, car, or other non-military bombing",
    "184": "Use as human shield",
    "185": "Attempt to assassinate",
    "186": "Assassinate",
    "190": "Use conventional military force",
    "191": "Impose blockade, restrict movement",
    "192": "Occupy territory",
    "193": "Fight with small arms and light weapons",
    "194": "Fight with artillery and tanks",
    "195": "Employ aerial weapons",
    "196": "Violate ceasefire",
    "200": "Use unconventional mass violence",
    "201": "Engage in mass expulsion",
    "202": "Engage in mass killings",
    "203": "Engage in ethnic cleansing",
    "204": "Use weapons of mass destruction",
}
QUAD_CLASS_LABELS = {1: "Verbal Cooperation", 2: "Material Cooperation", 3: "Verbal Conflict", 4: "Material Conflict"}

# Source families of domains, and suffixes of state domains.
SOURCE_FAMILY = {
    "xinhua.net": "state",
    "xinhuanet.com": "state",
    "chinadaily.com.cn": "state",
    "globaltimes.cn": "state",
    "en.people.cn": "state",
    "cgtn.com": "state",
    "rt.com": "state",
    "ria.ru": "state",
    "tass.ru": "state",
    "sputniknews.com": "state",
    "presstv.ir": "state",
    "press.ir": "state",
    "irna.ir": "state",
    "france24.com": "state",
    "dw.com": "state",
    "bbc.co.uk": "state",
    "bbc.com": "state",
    "abc.net.au": "state",
    "nhk.or.jp": "state",
    "voanews.com": "state",
    "rferl.org": "state",
    "almayadeen.net": "state",
    "aa.com.tr": "state",
    "trtworld.com": "state",
    "wam.ae": "state",
    "spa.gov.sa": "state",
    "qna.org.qa": "state",
    "telesurtv.net": "state",
    "prensa-latina.cu": "state",
    "cubadebate.cu": "state",
    "granma.cu": "state",
    "yonhapnewsagency.com": "state",
    "koreatimes.co.kr": "state",
    "jordantimes.com": "state",
    "egypttoday.com": "state",
    "egyptindependent.com": "state",
    "reuters.com": "wire",
    "apnews.com": "wire",
    "afp.com": "wire",
    "bloomberg.com": "wire",
    "bloomberg.net": "wire",
    "dpa-international.com": "wire",
    "efe.com": "wire",
    "dpa.com": "wire",
    "ansa.it": "wire",
}
STATE_SUFFIXES = [".gov", ".mil", ".gov.uk", ".gc.ca", ".gob.mx", ".gob.ar", ".gov.au"]

# Names of countries in queries, in either of two languages.
COUNTRY_ALIASES = {
    "united states": "US",
    "estados unidos": "US",
    "united kingdom": "GB",
    "reino unido": "GB",
    "south africa": "ZA",
    "sudafrica": "ZA",
    "south korea": "KR",
    "corea del sur": "KR",
    "north korea": "KP",
    "corea del norte": "KP",
    "saudi arabia": "SA",
    "arabia saudita": "SA",
    "new zealand": "NZ",
    "nueva zelanda": "NZ",
    "costa rica": "CR",
    "el salvador": "SV",
    "sri lanka": "LK",
    "puerto rico": "PR",
    "dominican republic": "DO",
    "republica dominicana": "DO",
    "colombia": "CO",
    "brazil": "BR",
    "brasil": "BR",
    "mexico": "MX",
    "argentina": "AR",
    "venezuela": "VE",
    "peru": "PE",
    "chile": "CL",
    "ecuador": "EC",
    "bolivia": "BO",
    "uruguay": "UY",
    "paraguay": "PY",
    "panama": "PA",
    "cuba": "CU",
    "haiti": "HT",
    "russia": "RU",
    "rusia": "RU",
    "china": "CN",
    "india": "IN",
    "germany": "DE",
    "alemania": "DE",
    "france": "FR",
    "francia": "FR",
    "spain": "ES",
    "espana": "ES",
    "italy": "IT",
    "italia": "IT",
    "japan": "JP",
    "japon": "JP",
    "israel": "IL",
    "iran": "IR",
    "ukraine": "UA",
    "ucrania": "UA",
    "turkey": "TR",
    "turquia": "TR",
    "pakistan": "PK",
    "indonesia": "ID",
    "canada": "CA",
    "australia": "AU",
    "nigeria": "NG",
    "ghana": "GH",
    "kenya": "KE",
    "kenia": "KE",
    "ethiopia": "ET",
    "etiopia": "ET",
    "egypt": "EG",
    "egipto": "EG",
    "angola": "AO",
    "sudan": "SD",
    "congo": "CD",
    "myanmar": "MM",
    "syria": "SY",
    "siria": "SY",
    "poland": "PL",
    "polonia": "PL",
    "netherlands": "NL",
    "holanda": "NL",
    "sweden": "SE",
    "suecia": "SE",
    "norway": "NO",
    "noruega": "NO",
    "denmark": "DK",
    "dinamarca": "DK",
    "finland": "FI",
    "finlandia": "FI",
    "portugal": "PT",
    "greece": "GR",
    "grecia": "GR",
    "romania": "RO",
    "rumania": "RO",
    "afghanistan": "AF",
    "afganistan": "AF",
    "somalia": "SO",
    "libya": "LY",
    "libia": "LY",
    "yemen": "YE",
    "iraq": "IQ",
    "irak": "IQ",
    "taiwan": "TW",
    "vietnam": "VN",
    "philippines": "PH",
    "filipinas": "PH",
    "malaysia": "MY",
    "malasia": "MY",
    "thailand": "TH",
    "tailandia": "TH",
    "bangladesh": "BD",
}

# Domains whose items are not taken in; domains below them are not, either.
BLOCKED_DOMAINS = [
    "iheart.com",
    "iheartradio.com",
    "tmz.com",
    "pagesix.com",
    "eonline.com",
    "radaronline.com",
    "thesun.co.uk",
    "dailystar.co.uk",
    "ok.co.uk",
    "hellomagazine.com",
    "people.com",
    "usmagazine.com",
    "bleacherreport.com",
    "sportingnews.com",
    "audioboom.com",
    "podbean.com",
    "buzzsprout.com",
    "prweb.com",
    "prnewswire.com",
    "businesswire.com",
    "globenewswire.com",
    "accesswire.com",
    "macrumors.com",
    "9to5mac.com",
    "appleinsider.com",
    "iphoneincanada.ca",
    "phonearena.com",
    "gsmarena.com",
    "androidpolice.com",
    "androidauthority.com",
    "theverge.com",
    "engadget.com",
    "gizmodo.com",
    "techradar.com",
    "tomsguide.com",
    "tomshardware.com",
    "pcmag.com",
    "cnet.com",
    "zdnet.com",
    "drugwatch.com",
    "classaction.org",
    "legalnewsline.com",
    "topclassactions.com",
    "aboutlawsuits.com",
    "lawyersandsettlements.com",
    "naturalnews.com",
    "greenmedinfo.com",
    "mercola.com",
    "patch.com",
    "local10.com",
    "local12.com",
    "fox5atlanta.com",
    "fox5ny.com",
    "fox4news.com",
    "wkrn.com",
    "wsmv.com",
    "wvlt.tv",
    "wbir.com",
    "nfl.com",
    "nba.com",
    "mlb.com",
    "nhl.com",
    "espn.com",
    "cbssports.com",
    "si.com",
    "theathletic.com",
    "ign.com",
    "gamespot.com",
    "kotaku.com",
    "polygon.com",
    "pcgamer.com",
    "screenrant.com",
    "collider.com",
    "rottentomatoes.com",
    "imdb.com",
    "deadline.com",
    "hollywoodreporter.com",
    "variety.com",
]

# Domains that add to the quality of a country's sources, and those that take from it.
TRUSTED_DOMAINS = [
    "reuters.com",
    "apnews.com",
    "afp.com",
    "bbc.com",
    "bbc.co.uk",
    "nytimes.com",
    "washingtonpost.com",
    "theguardian.com",
    "economist.com",
    "ft.com",
    "wsj.com",
    "bloomberg.com",
    "cnn.com",
    "npr.org",
    "pbs.org",
    "aljazeera.com",
    "dw.com",
    "france24.com",
    "nhk.or.jp",
    "abc.net.au",
    "cbc.ca",
    "lemonde.fr",
    "spiegel.de",
    "elpais.com",
    "corriere.it",
    "scmp.com",
    "straitstimes.com",
    "thehindu.com",
    "japantimes.co.jp",
]
AGGREGATOR_DOMAINS = [
    "yahoo.com",
    "msn.com",
    "flipboard.com",
    "biztoc.com",
    "smartnews.com",
    "feedly.com",
    "news.google.com",
    "apple.news",
]

# Signed weights of words by language.
LEXICON = {
    "en": {
        "war": -2.5, "attack": -2.5, "killed": -3, "dead": -2.5, "wounded": -2,
        "crisis": -2, "violence": -2.5, "protest": -1.5, "riot": -2.5, "tension": -1.5,
        "sanction": -2, "embargo": -2, "threat": -2, "fail": -1.5, "collapse": -2.5,
        "corruption": -2, "scandal": -2, "fraud": -2, "fear": -1.5, "panic": -2,
        "famine": -3, "drought": -2, "disaster": -2.5, "deadly": -3, "fatal": -3,
        "strike": -1.5, "denounce": -2, "condemn": -2, "abuse": -2.5, "violate": -2,
        "peace": 2.5, "agreement": 2, "deal": 1.5, "treaty": 2, "ceasefire": 2.5,
        "aid": 1.5, "recovery": 2, "growth": 2, "victory": 2, "win": 1.5,
        "release": 1, "cooperation": 2, "support": 1.5, "rescue": 2, "reform": 1.5,
        "free": 1.5, "save": 2, "improve": 1.5, "success": 2, "elect": 1,
        "stabilize": 2, "celebrate": 2, "innovation": 1.5, "boost": 1.5, "praise": 2,
    },
    "es": {
        "guerra": -2.5, "ataque": -2.5, "muertos": -3, "muerto": -2.5, "heridos": -2,
        "crisis": -2, "violencia": -2.5, "protesta": -1.5, "tensión": -1.5, "tension": -1.5,
        "sanción": -2, "sancion": -2, "amenaza": -2, "fracaso": -1.5, "colapso": -2.5,
        "corrupción": -2, "corrupcion": -2, "escándalo": -2, "fraude": -2, "miedo": -1.5,
        "hambruna": -3, "sequía": -2, "sequia": -2, "desastre": -2.5, "mortal": -3,
        "huelga": -1.5, "condena": -2, "denuncia": -2, "abuso": -2.5, "violar": -2,
        "paz": 2.5, "acuerdo": 2, "tratado": 2, "tregua": 2.5, "alto el fuego": 2.5,
        "ayuda": 1.5, "recuperación": 2, "recuperacion": 2, "crecimiento": 2, "victoria": 2,
        "liberar": 1, "cooperación": 2, "cooperacion": 2, "apoyo": 1.5, "rescate": 2,
        "reforma": 1.5, "libre": 1.5, "salvar": 2, "mejorar": 1.5, "éxito": 2, "exito": 2,
        "estabilizar": 2, "celebrar": 2, "innovación": 1.5, "innovacion": 1.5, "elogio": 2,
    },
    "fr": {
        "guerre": -2.5, "attaque": -2.5, "morts": -3, "mort": -2.5, "blessés": -2, "blesses": -2,
        "crise": -2, "violence": -2.5, "manifestation": -1.5, "tension": -1.5,
        "sanction": -2, "embargo": -2, "menace": -2, "échec": -1.5, "echec": -1.5,
        "corruption": -2, "scandale": -2, "fraude": -2, "peur": -1.5, "panique": -2,
        "famine": -3, "sécheresse": -2, "secheresse": -2, "catastrophe": -2.5, "mortel": -3,
        "grève": -1.5, "greve": -1.5, "dénoncer": -2, "denoncer": -2, "condamner": -2,
        "paix": 2.5, "accord": 2, "traité": 2, "traite": 2, "cessez-le-feu": 2.5,
        "aide": 1.5, "reprise": 2, "croissance": 2, "victoire": 2, "victoire": 2,
        "libérer": 1, "liberer": 1, "coopération": 2, "cooperation": 2, "soutien": 1.5,
        "sauvetage": 2, "réforme": 1.5, "reforme": 1.5, "libre": 1.5, "sauver": 2,
        "succès": 2, "succes": 2, "stabiliser": 2, "célébrer": 2, "celebrer": 2,
    },
    "pt": {
        "guerra": -2.5, "ataque": -2.5, "mortos": -3, "morto": -2.5, "feridos": -2,
        "crise": -2, "violência": -2.5, "violencia": -2.5, "protesto": -1.5, "tensão": -1.5,
        "sanção": -2, "sancao": -2, "ameaça": -2, "ameaca": -2, "fracasso": -1.5, "colapso": -2.5,
        "corrupção": -2, "corrupcao": -2, "escândalo": -2, "fraude": -2, "medo": -1.5,
        "fome": -3, "seca": -2, "desastre": -2.5, "mortal": -3,
        "greve": -1.5, "condenar": -2, "denunciar": -2, "abuso": -2.5, "violar": -2,
        "paz": 2.5, "acordo": 2, "tratado": 2, "trégua": 2.5, "tregua": 2.5,
        "ajuda": 1.5, "recuperação": 2, "recuperacao": 2, "crescimento": 2, "vitória": 2,
        "libertar": 1, "cooperação": 2, "cooperacao": 2, "apoio": 1.5, "resgate": 2,
        "reforma": 1.5, "livre": 1.5, "salvar": 2, "melhorar": 1.5, "sucesso": 2,
    },
    "ar": {
        "حرب": -2.5, "هجوم": -2.5, "قتل": -3, "قتلى": -3, "جرحى": -2,
        "أزمة": -2, "عنف": -2.5, "احتجاج": -1.5, "توتر": -1.5,
        "عقوبة": -2, "تهديد": -2, "فشل": -1.5, "انهيار": -2.5,
        "فساد": -2, "فضيحة": -2, "احتيال": -2, "خوف": -1.5,
        "مجاعة": -3, "جفاف": -2, "كارثة": -2.5, "قاتل": -3,
        "إضراب": -1.5, "إدانة": -2, "تنديد": -2, "انتهاك": -2,
        "سلام": 2.5, "اتفاق": 2, "معاهدة": 2, "هدنة": 2.5, "وقف إطلاق النار": 2.5,
        "مساعدة": 1.5, "تعافي": 2, "نمو": 2, "نصر": 2, "فوز": 1.5,
        "إفراج": 1, "تعاون": 2, "دعم": 1.5, "إنقاذ": 2, "إصلاح": 1.5,
        "حر": 1.5, "إنقاذ": 2, "تحسين": 1.5, "نجاح": 2,
    },
}

# Languages whose scripts are not Latin.
NON_LATIN_LANGUAGES = ["ar", "fa", "he", "hi", "bn", "th", "ja", "ko", "zh", "am", "ti", "ka", "hy", "ur", "pa", "ta", "te"]

# Concepts, each a bundle of themes.
CONCEPTS = {
    "cobalt-mining": {
        "label": "Cobalt Mining",
        "description": "DRC and Central Africa cobalt extraction, child labor, EV supply chain, human rights",
        "themes": ["WB_507_ENERGY_AND_EXTRACTIVES", "LABOR", "WB_HUMAN_RIGHTS", "ECON_TRADE", "ARMEDCONFLICT"],
        "related_concepts": ["climate-minerals"],
        "aliases": [
            "minería de cobalto", "cobalto", "cobalt", "mineração de cobalto",
            "cobalt mine",
        ],
    },
    "arms-trafficking": {
        "label": "Arms Trafficking",
        "description": "Illicit weapons trade, smuggling networks, embargo violations, proxy wars",
        "themes": ["ARMEDCONFLICT", "SEIZE", "CRIME", "MILITARY", "TAX_TERROR"],
        "related_concepts": ["drug-trafficking"],
        "aliases": [
            "tráfico de armas", "contrabando de armas", "trafic d'armes",
            "arms trade", "weapon smuggling",
        ],
    },
    "drug-trafficking": {
        "label": "Drug Trafficking",
        "description": "Narco-trafficking networks, cartel violence, drug interdiction, money laundering",
        "themes": ["CRIME", "ARREST", "KILL", "TAX_TERROR", "ECON_TRADE"],
        "related_concepts": ["arms-trafficking", "money-laundering"],
        "aliases": [
            "narcotráfico", "tráfico de drogas", "trafic de drogue", "cartel",
            "drug trade", "narco",
        ],
    },
    "money-laundering": {
        "label": "Money Laundering",
        "description": "Financial crime, shell companies, offshore accounts, sanctions evasion",
        "themes": ["CRIME", "TAX_FNCACT", "ECON_TRADE", "ARREST", "WB_ANTI_CORRUPTION"],
        "related_concepts": ["drug-trafficking", "corruption"],
        "aliases": [
            "lavado de dinero", "blanqueo de capitales", "blanqueo", "blanchiment",
            "financial crime",
        ],
    },
    "corruption": {
        "label": "Corruption",
        "description": "Bribery, embezzlement, state capture, procurement fraud, kleptocracy",
        "themes": ["WB_ANTI_CORRUPTION", "WB_GOVERNANCE", "CRIME", "ARREST", "PROTEST"],
        "related_concepts": ["money-laundering", "sanctions"],
        "aliases": ["corrupción", "soborno", "corupção", "corruption", "bribery", "kleptocracy"],
    },
    "sanctions": {
        "label": "Sanctions & Embargoes",
        "description": "International sanctions, asset freezes, trade restrictions, compliance",
        "themes": ["ECON_TRADE", "MILITARY", "SEIZE", "WB_TRADE_POLICY", "WB_GOVERNANCE"],
        "related_concepts": ["arms-trafficking", "corruption"],
        "aliases": ["sanciones", "embargo", "sanções", "sanctions économiques", "asset freeze"],
    },
    "refugee-crisis": {
        "label": "Refugee Crisis",
        "description": "Forced displacement, asylum seekers, border crossings, humanitarian corridors",
        "themes": ["MIGRATION", "WB_HUMAN_RIGHTS", "ARMEDCONFLICT", "DISASTER", "WB_GOVERNANCE"],
        "related_concepts": ["armed-conflict", "humanitarian-aid"],
        "aliases": [
            "crisis de refugiados", "refugiados", "réfugiés", "desplazados",
            "asylum seekers", "migrantes",
        ],
    },
    "humanitarian-aid": {
        "label": "Humanitarian Aid",
        "description": "Emergency relief, food security, aid access, NGO operations, blockades",
        "themes": ["DISASTER", "WB_HUMAN_RIGHTS", "HEALTH", "ARMEDCONFLICT", "UNGP_DISASTER"],
        "related_concepts": ["refugee-crisis", "food-security"],
        "aliases": [
            "ayuda humanitaria", "asistencia humanitaria", "aide humanitaire",
            "humanitarian relief",
        ],
    },
    "food-security": {
        "label": "Food Security",
        "description": "Famine, food price crises, agricultural collapse, supply chain disruption",
        "themes": ["AGRICULTURE", "DISASTER", "ECON_INFLATION", "WB_1637_AGRICULTURE_AND_FOOD", "UNGP_DISASTER"],
        "related_concepts": ["humanitarian-aid", "climate-crisis"],
        "aliases": [
            "seguridad alimentaria", "hambre", "hambruna", "famine", "food crisis",
            "escasez de alimentos",
        ],
    },
    "climate-crisis": {
        "label": "Climate Crisis",
        "description": "Extreme weather, climate migration, emissions, energy transition, IPCC",
        "themes": ["WB_2810_CLIMATE_CHANGE", "DISASTER", "ENERGY", "AGRICULTURE", "MIGRATION"],
        "related_concepts": ["food-security", "climate-minerals"],
        "aliases": [
            "crisis climática", "cambio climático", "clima", "calentamiento global",
            "changement climatique", "climate change",
        ],
    },
    "climate-minerals": {
        "label": "Critical Minerals",
        "description": "Lithium, cobalt, rare earths — energy transition supply chains and geopolitics",
        "themes": ["WB_507_ENERGY_AND_EXTRACTIVES", "ECON_TRADE", "WB_TRADE_POLICY", "ARMEDCONFLICT"],
        "related_concepts": ["cobalt-mining", "climate-crisis"],
        "aliases": [
            "minerales críticos", "litio", "tierras raras", "lithium", "rare earth",
            "transition minerals",
        ],
    },
    "disinformation": {
        "label": "Disinformation & Propaganda",
        "description": "Information warfare, state media manipulation, fake news, influence operations",
        "themes": ["MEDIA_MSM", "CYBERATTACK", "MILITARY", "WB_GOVERNANCE", "TAX_TERROR"],
        "related_concepts": ["cyber-warfare", "elections"],
        "aliases": [
            "desinformación", "propaganda", "fake news", "noticias falsas", "infox",
            "manipulation de l'information",
        ],
    },
    "cyber-warfare": {
        "label": "Cyber Warfare",
        "description": "State-sponsored hacking, critical infrastructure attacks, espionage, ransomware",
        "themes": ["CYBERATTACK", "MILITARY", "WB_GOVERNANCE", "TAX_TERROR", "TECHNOLOGY"],
        "related_concepts": ["disinformation", "sanctions"],
        "aliases": [
            "guerra cibernética", "ciberataques", "ciberguerra", "hacking",
            "ransomware", "espionaje digital",
        ],
    },
    "elections": {
        "label": "Electoral Integrity",
        "description": "Election interference, voter suppression, disputed results, democratic backsliding",
        "themes": ["ELECTIONS", "PROTEST", "WB_GOVERNANCE", "MEDIA_MSM", "DISINFORMATION"],
        "related_concepts": ["disinformation", "corruption"],
        "aliases": [
            "elecciones", "fraude electoral", "integridad electoral", "elections",
            "voter fraud", "election interference",
        ],
    },
    "war-crimes": {
        "label": "War Crimes & Atrocities",
        "description": "Civilian targeting, chemical weapons, genocide, ICC prosecutions",
        "themes": ["ARMEDCONFLICT", "KILL", "WB_HUMAN_RIGHTS", "CRISISLEX_C03_DEAD_WOUNDED", "WB_GOVERNANCE"],
        "related_concepts": ["refugee-crisis", "sanctions"],
        "aliases": [
            "crímenes de guerra", "atrocidades", "crimen de guerra",
            "crimes de guerre", "atrocities",
        ],
    },
    "nuclear-threat": {
        "label": "Nuclear Threat",
        "description": "Nuclear weapons programs, proliferation, deterrence, IAEA inspections",
        "themes": ["MILITARY", "TAX_TERROR", "ECON_TRADE", "WB_GOVERNANCE", "ARMEDCONFLICT"],
        "related_concepts": ["arms-trafficking", "sanctions"],
        "aliases": [
            "amenaza nuclear", "armas nucleares", "proliferación nuclear",
            "nuclear weapons", "nucléaire",
        ],
    },
    "human-trafficking": {
        "label": "Human Trafficking",
        "description": "Modern slavery, forced labor, sex trafficking, smuggling networks, exploitation",
        "themes": ["CRIME", "ARREST", "WB_HUMAN_RIGHTS", "MIGRATION", "LABOR"],
        "related_concepts": ["arms-trafficking", "drug-trafficking", "refugee-crisis"],
        "aliases": [
            "trata de personas", "esclavitud moderna", "tráfico humano",
            "traite des êtres humains", "modern slavery",
        ],
    },
    "femicide": {
        "label": "Femicide & Gender Violence",
        "description": "Killings of women, gender-based violence, domestic violence, impunity",
        "themes": ["KILL", "CRISISLEX_C06_VIOLENCE", "WB_HUMAN_RIGHTS", "CRIME", "WB_632_WOMEN_IN_POLITICS"],
        "related_concepts": ["human-trafficking", "state-repression"],
        "aliases": [
            "femicidio", "feminicidio", "violencia de género",
            "violencia contra la mujer", "féminicide",
        ],
    },
    "genocide": {
        "label": "Genocide & Mass Atrocities",
        "description": "Ethnic cleansing, mass killings, crimes against humanity, ICC referrals",
        "themes": ["KILL", "ARMEDCONFLICT", "WB_HUMAN_RIGHTS", "CRISISLEX_C03_DEAD_WOUNDED", "MIGRATION"],
        "related_concepts": ["war-crimes", "refugee-crisis"],
        "aliases": [
            "genocidio", "limpieza étnica", "masacre", "génocide",
            "ethnic cleansing", "atrocidades masivas",
        ],
    },
    "press-freedom": {
        "label": "Press Freedom",
        "description": "Journalist safety, media censorship, attacks on press, legal harassment of reporters",
        "themes": ["MEDIA_MSM", "WB_HUMAN_RIGHTS", "WB_GOVERNANCE", "ARREST", "KILL"],
        "related_concepts": ["disinformation", "state-repression"],
        "aliases": [
            "libertad de prensa", "censura", "periodistas",
            "libertad de expresión", "liberté de la presse",
        ],
    },
    "pandemic-disease": {
        "label": "Pandemic & Disease Outbreaks",
        "description": "Epidemic outbreaks, vaccine access, public health emergencies, WHO response",
        "themes": ["HEALTH", "UNGP_DISASTER", "DISASTER_RESPONSE", "WB_GOVERNANCE", "ECON_TRADE"],
        "related_concepts": ["humanitarian-aid", "climate-crisis"],
        "aliases": [
            "pandemia", "epidemia", "brote", "vacunas", "salud pública",
            "pandémie", "outbreak",
        ],
    },
    "state-repression": {
        "label": "State Repression",
        "description": "Authoritarian crackdowns, political prisoners, mass arrests, dissent suppression",
        "themes": ["ARREST", "PROTEST", "WB_HUMAN_RIGHTS", "WB_GOVERNANCE", "MILITARY"],
        "related_concepts": ["press-freedom", "femicide", "corruption"],
        "aliases": [
            "represión estatal", "represión", "presos políticos", "autoritarismo",
            "répression", "political prisoners",
        ],
    },
    "blood-diamonds": {
        "label": "Blood Diamonds & Conflict Minerals",
        "description": "Diamonds and minerals funding armed conflict, illicit mining, resource wars",
        "themes": ["WB_507_ENERGY_AND_EXTRACTIVES", "WB_2432_FRAGILITY_CONFLICT_AND_VIOLENCE",
                   "ARMEDCONFLICT", "WB_ORGANIZED_CRIME", "WB_GOVERNANCE"],
        "related_concepts": ["cobalt-mining", "arms-trafficking", "corruption"],
        "aliases": [
            "conflict minerals", "conflict diamonds", "diamantes de sangre",
            "minerais de sang", "kimberley process", "diamants de sang",
            "resource curse", "maldición de recursos",
        ],
    },
    "electoral-fraud": {
        "label": "Electoral Fraud & Vote Manipulation",
        "description": "Rigged elections, voter suppression, ballot stuffing, electoral integrity",
        "themes": ["GOV_ELECTION", "WB_ELECTIONS", "WB_GOVERNANCE", "WB_ACCOUNTABILITY",
                   "EPU_CATS_NATIONAL_SECURITY"],
        "related_concepts": ["elections", "corruption", "disinformation"],
        "aliases": [
            "voter fraud", "election rigging", "ballot stuffing", "voter suppression",
            "fraude electoral", "manipulation électorale", "elecciones fraudulentas",
            "stolen election", "election integrity",
        ],
    },
    "narcotrafficking": {
        "label": "Narcotrafficking & Drug Cartels",
        "description": "Drug trafficking organizations, cartels, smuggling routes, drug wars",
        "themes": ["WB_DRUG_TRAFFICKING", "WB_ORGANIZED_CRIME", "WB_SECURITY_SECTOR",
                   "ARMEDCONFLICT", "SOC_GENERALCRIME"],
        "related_concepts": ["drug-trafficking", "arms-trafficking", "corruption"],
        "aliases": [
            "drug cartel", "narco", "narcotráfico", "cartel", "drug war", "guerra contra el narco",
            "drug trafficking", "cártel", "sinaloa", "narcotráfico", "fentanyl crisis",
            "cocaine trade", "heroin trade", "meth",
        ],
    },
    "forced-displacement": {
        "label": "Forced Displacement & Internal Refugees",
        "description": "IDPs, mass population movements due to conflict, persecution, or disaster",
        "themes": ["WB_DISPLACEMENT", "WB_REFUGEE", "WB_HUMANITARIAN",
                   "WB_2432_FRAGILITY_CONFLICT_AND_VIOLENCE", "CRISISLEX_C02_DISASTER"],
        "related_concepts": ["refugee-crisis", "humanitarian-aid", "war-crimes"],
        "aliases": [
            "internally displaced", "IDP", "desplazados internos", "desplazamiento forzado",
            "population displacement", "internal refugees", "déplacés internes",
        ],
    },
    "water-crisis": {
        "label": "Water Crisis & Scarcity",
        "description": "Water wars, drought, access to clean water, transboundary water disputes",
        "themes": ["WB_1619_WATER", "WB_WATER_AND_SANITATION", "CRISISLEX_C01_RESOURCE",
                   "WB_2810_CLIMATE_CHANGE", "UNGP_FORESTS_RIVERS_OCEANS"],
        "related_concepts": ["food-security", "climate-crisis", "humanitarian-aid"],
        "aliases": [
            "water scarcity", "drought", "water wars", "water rights", "escasez de agua",
            "crisis hídrica", "crise de l'eau", "water stress", "dam conflict",
        ],
    },
    "land-grabbing": {
        "label": "Land Grabbing & Dispossession",
        "description": "Forced evictions, illegal land acquisition, indigenous land rights",
        "themes": ["WB_LAND", "WB_HUMAN_RIGHTS", "WB_GOVERNANCE", "SOC_PROTEST",
                   "WB_DISPLACEMENT"],
        "related_concepts": ["corruption", "state-repression", "forced-displacement"],
        "aliases": [
            "land grab", "forced eviction", "desalojo forzado", "acaparamiento de tierras",
            "indigenous land", "derechos territoriales", "accaparement des terres",
        ],
    },
}

# Regions with their countries and their names in several languages.
SEARCH_REGIONS = {
    "africa": {
        "label": "Africa",
        "countries": [
            "DZ", "AO", "BJ", "BW", "BF", "BI", "CV", "CM", "CF", "TD",
            "KM", "CD", "CG", "CI", "DJ", "EG", "GQ", "ER", "SZ", "ET",
            "GA", "GM", "GH", "GN", "GW", "KE", "LS", "LR", "LY", "MG",
            "MW", "ML", "MR", "MU", "MA", "MZ", "NA", "NE", "NG", "RW",
            "ST", "SN", "SC", "SL", "SO", "ZA", "SS", "SD", "TZ", "TG",
            "TN", "UG", "ZM", "ZW",
        ],
        "aliases": [
            "africa", "afrika", "áfrica", "afrique", "afriqa",
        ],
    },
    "middle-east": {
        "label": "Middle East",
        "countries": [
            "BH", "CY", "EG", "IR", "IQ", "IL", "JO", "KW", "LB", "OM",
            "PS", "QA", "SA", "SY", "TR", "AE", "YE",
        ],
        "aliases": [
            "middle east", "medio oriente", "oriente medio", "moyen-orient",
            "moyen orient", "naher osten", "oriente médio", "oriente medio",
            "al-sharq al-awsat", "sharq awsat",
        ],
    },
    "latin-america": {
        "label": "Latin America",
        "countries": [
            "AR", "BO", "BR", "CL", "CO", "CR", "CU", "DO", "EC", "SV",
            "GT", "HN", "MX", "NI", "PA", "PY", "PE", "PR", "UY", "VE",
            "HT", "JM", "TT", "GY", "SR",
        ],
        "aliases": [
            "latin america", "latinoamérica", "latinoamerica", "américa latina",
            "america latina", "amérique latine", "amerique latine",
            "lateinamerika", "américa do sul", "sudamérica", "sudamerica",
            "centroamérica", "centroamerica", "central america", "south america",
            "caribe", "caribbean",
        ],
    },
    "europe": {
        "label": "Europe",
        "countries": [
            "AL", "AD", "AT", "BY", "BE", "BA", "BG", "HR", "CZ", "DK",
            "EE", "FI", "FR", "DE", "GR", "HU", "IS", "IE", "IT", "XK",
            "LV", "LT", "LU", "MT", "MD", "ME", "NL", "MK", "NO", "PL",
            "PT", "RO", "RU", "RS", "SK", "SI", "ES", "SE", "CH", "UA",
            "GB",
        ],
        "aliases": [
            "europe", "europa", "eu", "european union", "unión europea",
            "union europea", "union européenne", "união europeia",
        ],
    },
    "asia-pacific": {
        "label": "Asia-Pacific",
        "countries": [
            "AF", "AU", "BD", "BT", "BN", "KH", "CN", "FJ", "IN", "ID",
            "JP", "KZ", "KG", "LA", "MY", "MV", "MN", "MM", "NP", "NZ",
            "KP", "PK", "PH", "KR", "SG", "LK", "TW", "TJ", "TH", "TL",
            "TM", "UZ", "VN",
        ],
        "aliases": [
            "asia", "asia pacific", "asia-pacific", "asia pacífico",
            "asia pacifico", "asie", "asie-pacifique", "asien",
            "southeast asia", "east asia", "south asia", "sudeste asiático",
        ],
    },
    "north-america": {
        "label": "North America",
        "countries": ["US", "CA"],
        "aliases": [
            "north america", "norteamérica", "norteamerica",
            "amérique du nord", "amerique du nord", "nordamerika",
        ],
    },
}

# Seed topics: label, domain, terms, theme hints.
TOPIC_SEEDS = {
    "armed-conflict-escalation": ("Armed conflict escalation", "conflict-security", ["armed conflict","clashes","offensive","airstrike","shelling","militia","rebels"], ["ARMEDCONFLICT","MILITARY","KILL"]),
    "humanitarian-access-conflict": ("Humanitarian access under conflict", "migration-humanitarian", ["humanitarian corridor","aid convoy","relief access","displaced","refugee camp"], ["DISASTER_RESPONSE","REFUGEES","CRISISLEX_C03_DEAD_WOUNDED"]),
    "gang-control-urban-security": ("Gang control and urban security", "conflict-security", ["gang","cartel","extortion","prison riot","urban violence"], ["CRIME","TAX_TERROR","ARREST"]),
    "election-legitimacy-dispute": ("Election legitimacy dispute", "political-legitimacy", ["election fraud","contested election","vote count","electoral court","ballot"], ["ELECTION","GOVERNMENT","PROTEST"]),
    "constitutional-institutional-crisis": ("Constitutional or institutional crisis", "political-legitimacy", ["constitutional crisis","supreme court","impeachment","state of emergency","parliament dissolved"], ["GOVERNMENT","COURT","LEADER"]),
    "corruption-investigation": ("Corruption investigation", "political-legitimacy", ["corruption","bribery","embezzlement","procurement scandal","kickback"], ["CORRUPTION","INVESTIGATION","COURT"]),
    "fuel-subsidy-unrest": ("Fuel subsidy unrest", "economic-stress", ["fuel subsidy","gasoline price","diesel price","transport strike","fuel protest"], ["ECON_INFLATION","PROTEST","STRIKE"]),
    "food-price-stress": ("Food price stress", "economic-stress", ["food prices","bread price","rice price","shortage","food inflation","hunger"], ["ECON_INFLATION","FOOD_SECURITY","HEALTH"]),
    "currency-debt-stress": ("Currency and debt stress", "economic-stress", ["currency crisis","debt default","imf bailout","foreign reserves","devaluation"], ["ECON_BANKRUPTCY","ECON_INFLATION","ECON_STOCKMARKET"]),
    "mining-royalty-risk": ("Mining royalty and resource risk", "resources-energy", ["mining royalty","copper royalty","concession","resource nationalism","mining permit"], ["ECON_TRADE","TAX_FNCACT","ENV_MINING"]),
    "energy-grid-instability": ("Energy grid instability", "resources-energy", ["power outage","blackout","grid failure","energy rationing","electricity shortage"], ["ENERGY","INFRASTRUCTURE","ENV_CLIMATECHANGE"]),
    "oil-gas-supply-risk": ("Oil and gas supply risk", "resources-energy", ["pipeline","oil export","gas supply","lng","refinery"], ["ENERGY","ECON_TRADE","SANCTION"]),
    "water-stress-drought": ("Water stress and drought", "climate-disaster", ["drought","water rationing","reservoir","water shortage","dry season"], ["ENV_CLIMATECHANGE","UNGP_DISASTER","WATER_SECURITY"]),
    "flood-landslide-disaster": ("Flood and landslide disaster", "climate-disaster", ["flood","landslide","heavy rain","evacuation","mudslide"], ["UNGP_DISASTER","DISASTER_RESPONSE","ENV_CLIMATECHANGE"]),
    "heat-health-risk": ("Heat and public health risk", "public-health", ["heat wave","extreme heat","heatstroke","public health warning","thermal stress"], ["HEALTH","ENV_CLIMATECHANGE","UNGP_DISASTER"]),
    "disease-outbreak": ("Disease outbreak", "public-health", ["outbreak","epidemic","virus","vaccination","public health emergency"], ["HEALTH","MEDICAL","CRISISLEX_C07_SAFETY"]),
    "migration-border-pressure": ("Migration and border pressure", "migration-humanitarian", ["migrant caravan","border crossing","asylum","deportation","refugee"], ["MIGRATION","REFUGEES","HUMAN_RIGHTS"]),
    "forced-displacement": ("Forced displacement", "migration-humanitarian", ["internally displaced","forced displacement","evacuated families","displacement camp"], ["REFUGEES","HUMAN_RIGHTS","ARMEDCONFLICT"]),
    "labor-strike-disruption": ("Labor strike disruption", "social-unrest-labor", ["strike","union","wage dispute","walkout","labor protest"], ["LABOR","STRIKE","PROTEST"]),
    "student-youth-protest": ("Student and youth protest", "social-unrest-labor", ["student protest","campus protest","youth movement","tuition protest"], ["PROTEST","EDUCATION","SOC_POINTSOFVIEW"]),
    "gender-violence-rights": ("Gender violence and rights", "social-unrest-labor", ["femicide","gender violence","women rights","reproductive rights"], ["HUMAN_RIGHTS","KILL","PROTEST"]),
    "transport-corridor-disruption": ("Transport corridor disruption", "technology-infrastructure", ["port disruption","road blockade","rail strike","canal","bridge collapse"], ["TRANSPORT","INFRASTRUCTURE","ECON_TRADE"]),
    "cyberattack-infrastructure": ("Cyberattack on infrastructure", "technology-infrastructure", ["cyberattack","ransomware","data breach","critical infrastructure","hackers"], ["CYBER_ATTACK","TECHNOLOGY","INFRASTRUCTURE"]),
    "telecom-internet-shutdown": ("Telecom or internet shutdown", "technology-infrastructure", ["internet shutdown","telecom outage","network disruption","censorship","connectivity"], ["TECHNOLOGY","MEDIA_CENSORSHIP","HUMAN_RIGHTS"]),
    "disinformation-influence-operation": ("Disinformation and influence operation", "information-environment", ["disinformation","propaganda","influence operation","fake news","bot network"], ["MEDIA_MSM","SOC_POINTSOFVIEW","TAX_FNCACT"]),
    "press-freedom-crackdown": ("Press freedom crackdown", "information-environment", ["journalist arrested","press freedom","media censorship","newsroom raid","reporter detained"], ["MEDIA_CENSORSHIP","HUMAN_RIGHTS","ARREST"]),
    "sanctions-diplomatic-pressure": ("Sanctions and diplomatic pressure", "political-legitimacy", ["sanctions","diplomatic pressure","embassy","treaty","negotiations"], ["SANCTION","TAX_DIPLOMACY","TREATY"]),
    "trade-export-restriction": ("Trade and export restriction", "economic-stress", ["export ban","tariff","trade dispute","customs","shipping restriction"], ["ECON_TRADE","SANCTION","TAX_DIPLOMACY"]),
    "housing-cost-pressure": ("Housing cost pressure", "economic-stress", ["rent increase","housing crisis","eviction","mortgage","affordable housing"], ["ECON_INFLATION","SOC_ECONCOSTOFLIVING","PROTEST"]),
    "agriculture-crop-risk": ("Agriculture and crop risk", "climate-disaster", ["crop failure","harvest","fertilizer","pest outbreak","farmers"], ["AGRICULTURE","FOOD_SECURITY","ENV_CLIMATECHANGE"]),
}

# Places that look like persons' names, and first words of names that are no persons'.
PLACE_NAMES = [
    "abu dhabi", "saudi arabia", "north korea", "south korea", "north africa",
    "south africa", "north america", "south america", "latin america",
    "united states", "united kingdom", "united nations", "united arab emirates",
    "new york", "new delhi", "new zealand", "new jersey", "new mexico",
    "hong kong", "puerto rico", "costa rica", "ivory coast", "sierra leone",
    "burkina faso", "guinea bissau", "equatorial guinea", "papua new guinea",
    "el salvador", "sri lanka", "west bank", "west africa", "east africa",
    "middle east", "central asia", "southeast asia", "south asia",
    "european union", "african union", "las vegas", "los angeles", "san francisco",
    "san jose", "san diego", "rio de janeiro", "sao paulo", "buenos aires",
    "kuala lumpur", "tel aviv", "cape town", "addis ababa", "dar es salaam",
]
PLACE_FIRST_WORDS = ["north", "south", "east", "west", "central", "greater", "upper", "lower"]

# Words that name a country, in the order in which they are tried; the first one that a text has decides.
COUNTRY_WORDS = [
    ("IR", "Iran, Iranian, Tehran, IRGC, Khamenei, Araghchi"),
    ("UA", "Ukraine, Ukrainian, Kyiv, Zelenskyy, Zelenskiy"),
    ("RU", "Russia, Russian, Moscow, Kremlin, Putin, Rossiya"),
    ("GZ", "Gaza, Palestine, Palestinian, Hamas, Rafah, West Bank"),
    ("IL", "Israel, Israeli, Tel Aviv, Netanyahu, IDF"),
    ("MM", "Myanmar, Burma, Rangoon, Naypyidaw, Tatmadaw, Military junta"),
    ("SO", "Somalia, Somali, Mogadishu, Al-Shabaab"),
    ("YE", "Yemen, Yemeni, Sanaa, Houthi, Aden"),
    ("SD", "Sudan, Sudanese, Khartoum, Darfur, RSF"),
    ("AF", "Afghanistan, Afghan, Kabul, Taliban"),
    ("PK", "Pakistan, Pakistani, Islamabad, Karachi, Sharif"),
    ("IN", "India, Indian, New Delhi, Mumbai, Modi"),
    ("CN", "China, Chinese, Beijing, Shanghai, Xi Jinping"),
    ("KP", "North Korea, North Korean, Pyongyang, Kim Jong"),
    ("SY", "Syria, Syrian, Damascus, Assad"),
    ("LB", "Lebanon, Lebanese, Beirut, Hezbollah"),
    ("SA", "Saudi Arabia, Saudi, Riyadh, MBS"),
    ("IQ", "Iraq, Iraqi, Baghdad, Basra"),
    ("LY", "Libya, Libyan, Tripoli, Benghazi"),
    ("ET", "Ethiopia, Ethiopian, Addis Ababa, Tigray"),
    ("CD", "DR Congo, DRC, Congo, Kinshasa, M23"),
    ("HT", "Haiti, Haitian, Port-au-Prince"),
    ("VE", "Venezuela, Venezuelan, Caracas, Maduro"),
    ("BR", "Brazil, Brazilian, Brasilia, Lula, São Paulo"),
    ("US", "United States, American, Washington, Trump, Pentagon"),
    ("GB", "United Kingdom, British, London, Starmer, Downing Street"),
    ("FR", "France, French, Paris, Macron, Elysée"),
    ("DE", "Germany, German, Berlin, Bundestag"),
    ("IR", "Strait of Hormuz, Hormuz, Persian Gulf, Gulf of Oman"),
    ("YE", "Red Sea, Gulf of Aden, Bab el-Mandeb"),
    ("TW", "Taiwan, Taipei, Taiwanese"),
    ("CO", "Colombia, Colombian, Bogotá, Bogota, Petro, FARC"),
    ("PE", "Peru, Peruvian, Lima, Boluarte"),
    ("AR", "Argentina, Argentine, Buenos Aires, Milei"),
    ("CL", "Chile, Chilean, Santiago, Boric"),
    ("MX", "Mexico, Mexican, México, Mexico City, Sheinbaum, Cartel"),
    ("EC", "Ecuador, Ecuadorian, Quito, Noboa"),
    ("BO", "Bolivia, Bolivian, La Paz, Arce"),
    ("PY", "Paraguay, Paraguayan, Asunción"),
    ("UY", "Uruguay, Uruguayan, Montevideo"),
    ("CU", "Cuba, Cuban, Havana, Díaz-Canel"),
    ("NI", "Nicaragua, Nicaraguan, Managua, Ortega"),
    ("EG", "Egypt, Egyptian, Cairo, El-Sisi, Sisi"),
    ("TR", "Turkey, Turkish, Ankara, Istanbul, Erdogan, Erdoğan"),
    ("MA", "Morocco, Moroccan, Rabat, Casablanca"),
    ("TN", "Tunisia, Tunisian, Tunis, Saied"),
    ("JO", "Jordan, Jordanian, Amman, Abdullah"),
    ("AE", "UAE, Dubai, Abu Dhabi, Emirati"),
    ("QA", "Qatar, Qatari, Doha"),
    ("KW", "Kuwait, Kuwaiti"),
    ("NG", "Nigeria, Nigerian, Abuja, Lagos, Tinubu, Boko Haram"),
    ("KE", "Kenya, Kenyan, Nairobi, Ruto"),
    ("ZA", "South Africa, South African, Johannesburg, Pretoria, Ramaphosa, ANC"),
    ("GH", "Ghana, Ghanaian, Accra, Mahama"),
    ("TZ", "Tanzania, Tanzanian, Dar es Salaam, Dodoma"),
    ("UG", "Uganda, Ugandan, Kampala, Museveni"),
    ("CM", "Cameroon, Cameroonian, Yaoundé, Douala"),
    ("ZW", "Zimbabwe, Zimbabwean, Harare, Mnangagwa"),
    ("MZ", "Mozambique, Mozambican, Maputo, Frelimo"),
    ("AO", "Angola, Angolan, Luanda, MPLA"),
    ("SN", "Senegal, Senegalese, Dakar, Faye"),
    ("ML", "Mali, Malian, Bamako, Wagner"),
    ("BF", "Burkina Faso, Ouagadougou, Traoré"),
    ("NE", "Niger, Nigerien, Niamey, Tiani"),
    ("PH", "Philippines, Filipino, Manila, Marcos, Duterte"),
    ("ID", "Indonesia, Indonesian, Jakarta, Prabowo"),
    ("SG", "Singapore, Singaporean, Lee Hsien Loong, Lawrence Wong"),
    ("TH", "Thailand, Thai, Bangkok, junta, Pita"),
    ("VN", "Vietnam, Vietnamese, Hanoi, Ho Chi Minh"),
    ("MY", "Malaysia, Malaysian, Kuala Lumpur, Anwar"),
    ("KH", "Cambodia, Cambodian, Phnom Penh, Hun Sen, Hun Manet"),
    ("LA", "Laos, Lao, Vientiane"),
    ("BD", "Bangladesh, Bangladeshi, Dhaka, Yunus"),
    ("LK", "Sri Lanka, Sri Lankan, Colombo, Dissanayake"),
]

# The encyclopedia edition whose page views stand for a country.
COUNTRY_EDITION = {"US": "en", "GB": "en", "IN": "en", "ES": "es", "CO": "es", "MX": "es", "AR": "es", "BR": "pt", "FR": "fr", "DE": "de", "IT": "it", "JP": "ja", "KR": "ko", "CN": "zh", "RU": "ru", "TR": "tr", "UA": "uk"}

# How callsigns of military and government aircraft begin, and the first two digits of military addresses.
MILITARY_PREFIXES = ["RCH", "PAT", "REACH", "DUKE", "VALOR", "ZEUS", "TOPCAT", "VENUS", "NAVY", "USAF", "ARMY", "RAF", "RRR", "GAF", "GAFMED", "FAF", "CTM", "IAF", "NATO", "NATOEX", "RFF", "MAGMA", "COBRA", "VIPER", "GHOST"]
GOVERNMENT_PREFIXES = ["SAM", "AF1", "AF2", "EXEC", "VENUS0", "SPAR", "CAPS", "IRON"]
MILITARY_ADDRESSES = ["ae", "af", "43"]
