"""Word lists, weights and thresholds. All of them are fixed values: results depend on exactly these."""

# Role tiers; the first tier with a keyword inside the title decides (category, authority).
ROLE_TIERS = [
    ("founder", 25, ["founder", "founder & ceo", "co-founder", "cofounder", "創業者", "创设者", "创始人"]),
    ("owner", 24, ["owner", "proprietor", "sole proprietor", "part owner"]),
    ("chief_executive", 23, ["chief executive", "ceo", "ceo & founder", " managing director", "ceo/md", "geschäftsführer", "代表執行役", "代表取締役", "代表者", "社长", "社長", "法定代表人", "总经理", "執行長", "대표이사"]),
    ("chief_operating", 20, ["coo", "chief operating", "co-founder & coo"]),
    ("executive", 19, ["president", "président", "cto", "chief technology", "chief product", "chief financial", "cfo", "chief information"]),
    ("senior_leader", 16, ["founding partner", "managing partner", "partner", "head of", "head designer", "head developer", "head engineer", "vp ", "vice president", "vice-president", "general manager", "gm", "geschäftsführung", "本部長", "室長", "部长", "负责人", "head of "]),
    ("commercial_leader", 14, ["business development", "partnerships", "partnership", "bdm", "sales director", "head of sales", "account executive", " partnerships", "商务合作", "事業開発", "営業", "提携"]),
    ("product_leader", 12, ["product manager", "product lead", "head of product", "product owner", "产品经理", "プロダクト"]),
    ("operations_leader", 11, ["operations", "ops lead", "head of ops", "general operations"]),
    ("marketing_leader", 9, ["marketing", "growth", "head of marketing", "cmc"]),
    ("non_executive", 5, ["investor", "advisor", "board", "director", "non-executive", "supervisor"]),
    ("individual_contributor", 3, ["engineer", "developer", "designer", "consultant", "employee", "staff", "intern", "coordinator", "specialist", "staff engineer"]),
]
# Seniority of titles, highest first.
SENIORITY = ["founder", "owner", "ceo", "chief executive", "president", "managing director", "representative director", "coo", "cto", "cfo", "cmo", "vp", "vice president", "head of", "general manager", "director"]
# Hints that a role has ended.
ENDED_HINTS = ["former", "previously", "ex-", "past ", "until 20", "2019", "2018", "2017", "joined ", "left ", "deceased"]
# Adjustment of authority by company size and role category.
SIZE_PREFERENCE = {
    "small": {"founder": 4, "owner": 4, "chief_executive": 3, "senior_leader": 0, "commercial_leader": -1, "non_executive": -3, "individual_contributor": -4},
    "medium": {"founder": 2, "owner": 2, "chief_executive": 3, "executive": 2, "senior_leader": 2, "commercial_leader": 2, "non_executive": -2, "individual_contributor": -3},
    "large": {"founder": 0, "owner": 0, "chief_executive": 3, "executive": 3, "senior_leader": 3, "commercial_leader": 3, "product_leader": 1, "non_executive": -1, "individual_contributor": -4},
}
# Relevance of role categories; any other has 4.
RELEVANCE = {"founder": 20, "owner": 20, "chief_executive": 19, "chief_operating": 16, "executive": 16, "senior_leader": 15, "commercial_leader": 18, "product_leader": 12, "operations_leader": 10, "marketing_leader": 9, "non_executive": 4, "individual_contributor": 2, "unknown": 4}
# Trust in source types; any other has 0.4.
HOST_TRUST = {"company_site": 1.0, "registry": 0.95, "press_release": 0.85, "partner_announcement": 0.8, "news": 0.7, "interview": 0.7, "product_hunt": 0.7, "conference": 0.65, "social_profile": 0.6, "github": 0.55, "pdf": 0.55, "directory": 0.45, "job_board": 0.4, "forum": 0.25, "other": 0.4}
# Source types by substrings of "host title", in order.
SOURCE_RULES = [
    ("product_hunt", ["producthunt.com"]),
    ("github", ["github.com", "gitlab.com", "bitbucket.org", "gitee.com"]),
    ("registry", ["opencorporates.com", "company-information.service.gov.uk", "national-tax-agency", "houjin.jp", "gBizINFO", "gsxt.gov.cn", "unido.org", "europa.eu", "sec.gov", "registers", "commercial-register", "germany", "northdata.de", "companyhouse", "or.jp", "registry"]),
    ("press_release", ["prnewswire.com", "businesswire.com", "globenewswire.com", "einpresswire.com", "newsfilecorp.com", "accesswire.com"]),
    ("partner_announcement", ["partners", "partner.", "integrations", "alliance"]),
    ("conference", ["conference", "congress", "summit", "expo", "webinar", "meetup.com", "eventbrite", "mktplace", "tradeshow"]),
    ("interview", ["interview", "podcast", "youtube.com", "youtu.be"]),
    ("pdf", [".pdf"]),
    ("news", ["news", "times", "post", "herald", "journal", "gazette", "reuters", "bloomberg", "forbes", "techcrunch", "venturebeat"]),
    ("social_profile", ["linkedin.com", "x.com", "twitter.com", "facebook.com", "instagram.com", "medium.com", "substack", "note.com"]),
    ("job_board", ["linkedin.com/jobs", "indeed", "glassdoor", "wellfound", "angel.co", "otta.com", "wellfound.com"]),
    ("directory", ["crunchbase", "pitchbook", "zoominfo", "apollo.io", "clay.com", "signalhire", "leadiq", "apollo", "f6s.com", "producthunt.com/topics", "clutch.co", "g2.com", "capterra"]),
]
# Endings of hosts that look like a company's own site.
SITE_SUFFIXES = [".com", ".co", ".io", ".ai", ".jp", ".cn", ".de", ".uk", ".it", ".es", ".nl", ".fr", ".se", ".ch", ".at", ".pt", ".be", ".pl", ".hr", ".cz", ".kr", ".in", ".ca", ".au", ".nz", ".br", ".mx", ".za", ".mt", ".ad", ".cm", ".eu", ".org", ".net"]
# Hosts that score 0, and hosts that score more.
LOW_VALUE_HOSTS = ["pinterest.com", "quora.com", "reddit.com", "youtube.com", "facebook.com", "instagram.com", "twitter.com", "x.com", "tiktok.com", "linkedin.com", "wikipedia.org", "wikidata.org", "amazon.com", "ebay.com", "alibaba.com", "indeed.com", "glassdoor.com", "yelp.com", "tripadvisor.com", "foursquare.com", "crunchbase.com", "medium.com", "blogspot.com", "wordpress.com", "translate.google.com", "webcache.googleusercontent.com"]
HIGH_VALUE_HOSTS = ["producthunt.com", "github.com", "gitlab.com", "prnewswire.com", "businesswire.com", "globenewswire.com", "europa.eu", "gov.uk", "go.jp", "lg.jp", ".go.jp", ".gob.jp", "unido.org", "wipo.int", "sec.gov", "find-and-update.company-information.service.gov.uk", "opencorporates.com", "pitchbook.com", "crunchbase.com", "techcrunch.com", "linkedin.com", "medium.com", "devpost.com", "ycombinator.com", "kiep.uzh.ch", "dealroom.co", "zoominfo.com", "signalhire.com"]
# URLs that are not worth a fetch; path segments of pages about people.
LOW_VALUE_URL = r"(?i)(/tag/|/tags/|/category/|/categories/|/topics?/|/search\?|/page/[0-9]|/blog/[0-9]|/archive|\.pdf($|\?)|/print/?$)"
PEOPLE_SEGMENTS = ["team", "our-team", "meet-the-team", "meet-our-team", "team-members", "about", "about-us", "aboutus", "who-we-are", "leadership", "leaders", "leadership-team", "our-leadership", "management", "management-team", "executive", "executives", "executive-team", "board", "board-of-directors", "directors", "founders", "founder", "staff", "people", "our-people", "key-people", "officers", "principals", "partners", "directory", "employees", "equipo", "equipe", "uber-uns", "ueber-uns", "sobre-nosotros", "chi-siamo", "quem-somos", "over-ons", "nosotros", "azienda", "unternehmen", "会社概要", "経営陣", "团队"]
# URLs of pages that name products rather than people.
NOT_PEOPLE_SOURCE = (
    r"(?i)(apps\.apple\.com|play\.google\.com|chromewebstore|apps\.microsoft\.com|/app/[^/]+/id[0-9]+|appsumo\.|g2\.com|capterra\.|softwareadvice\.|crunchbase\.com|zoominfo\.com|apollo\.io|clay\.com|signalhire\."
    r"|developers\.google\.com|developer\.apple\.com|/docs?/|/api/|/developers/|/partners?/|/integration|listsignal\.|builtwith\.|wappalyzer\.|hyperping\.|whatcms\.|statscrop\.|websiteseocheckers\.|sitechecker\.|browserstack\.|similarweb\."
    r"|semrush\.com/website|ahrefs\.com/site|spyfu\.com|wikipedia\.org/wiki/.*(discography|chart|charts|awards|category:))"
)
# Weights of internal links; the first group with a word inside "url anchor" counts.
LINK_WEIGHTS = [
    (3.0, ["about", "über-uns", "ueber-uns", "quem-somos", "chi-siamo", "a-propos", "会社概要", "公司介绍", "企業情報", "about-us", "over-ons", "sur-nous", "acerca-de", "sobre-nos", "o-nas", "о нас", "om-os", "aboutus"]),
    (2.6, ["team", "people", "mitarbeiter", "equipo", "équipe", "staff", "leadership", "management", "our-people", "chi-siamo", "中国社会", "スタッフ", "社員", "経営陣", "团队", "组织", " 멤버", "τομάς", "керів", "board", "directory", "member", "membership", "faculty", "tutor", "doctors", "teachers", "speakers", "partners", "founders"]),
    (2.4, ["contact", "kontakt", "contacto", "contatti", "contato", "get-in-touch", "inquiry", "enquiry", "reach-us", "iletisim", "お問い合わせ", "名录", "联系", "聯絡", "-contact", "support", "help", "reach", "contactez", "napisz", "porcontacto", "fale-conosco"]),
    (1.8, ["impressum", "mentions-legales", "mentions-légales", "legal-notice", "legal", "colofon", "attribution", "特定商取引法", "会社情報", "약관", "qui-sommes-nous", "aviso-legal", "informazioni", "informazioni-legali", "regeln", "note-legali", "yousa-privacy"]),
    (1.4, ["privacy", "terms", "conditions", "tos", "agb", "cookie", "gdpr", "disclaimer", " recruiting", "careers", "jobs", "work-with-us", "採用情報", "recruit", "採用", "招聘", "privacy-policy", "privacy-notice"]),
    (2.2, ["company", "corporate", "organization", "organisation", "profile", "company-profile", "corporate-profile", "wir-ueber-uns", "unternehmen", "azienda", "societe", "société", "empresa", "会社概要", "会社情報"]),
    (1.0, ["press", "news", "media", "blog", "newsroom", "news-room", "presse", "actualites", "noticias", "ニュース", "お知らせ", "新闻", "media-centre", "resources", "case-stud", "customers", "client", "kunde", "clients"]),
]
# Addresses of mail.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)+"
EMAIL_JUNK = ["example.com", "example.org", "domain.com", "yourdomain", "email.com", "sentry.io", "wixpress.com", "squarespace.com", "godaddy.com", "cloudflare.com", "schema.org", "w3.org", "wordpress.com", "2x.png", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".css", ".js", "sentry", "no-reply@", "noreply@", "donotreply", "postmaster", "webmaster", "abuse@", "mailer-daemon", "bounce", "unsubscribe", "@2x", "@3x", "googlemail.com", "reactjs.org", "bootstrapcdn", "jsdelivr", "unpkg", "@types", ".png@"]
GENERIC_LOCALS = ["email", "e-mail", "mail", "your", "name", "here", "click", "button", "submit", "example", "test", "user", "you"]
ROLE_LOCALS = ["info", "contact", "hello", "hi", "support", "sales", "admin", "office", "enquiries", "enquiry", "inquiries", "inquiry", "mail", "email", "team", "help", "helpdesk", "service", "services", "booking", "bookings", "reservations", "reservation", "press", "media", "pr", "careers", "jobs", "hr", "partnerships", "partners", "bd", "business", "bizdev", "welcome", "reception", "front", "desk", "billing", "accounts", "accounting", "invoice", "webmaster", "postmaster", "abuse", "noreply", "no-reply", "donotreply", "marketing", "newsletter", "legal", "privacy", "security", "compliance", "feedback", "customerservice", "customers", "stay", "groups", "partnership", "collab", "collabo", "toi", "owa", "all", "everybody", "everyone", "contacto", "contactus", "kontakt", "vendas", "vertrieb", "commercial", "commerciale", "boutique", "ventas", "zakaz", "orders", "order", "shop", "shopinfo", "b2b", "wholesale", "export", "import", "general", "main", "hq", "secretary", "vorstand"]
PATTERN_LOCALS = ["info", "contact", "hello", "support", "sales", "admin", "office", "enquiries", "mail", "team", "help", "hi"]
PERSONAL_PROVIDERS = ["gmail.com", "googlemail.com", "yahoo.com", "yahoo.co.jp", "yahoo.co.uk", "ymail.com", "hotmail.com", "hotmail.co.uk", "outlook.com", "live.com", "msn.com", "aol.com", "icloud.com", "me.com", "mac.com", "protonmail.com", "proton.me", "pm.me", "gmx.com", "gmx.de", "web.de", "mail.ru", "yandex.ru", "qq.com", "163.com", "126.com", "naver.com", "daum.net", "seznam.cz", "libero.it", "orange.fr", "free.fr", "wanadoo.fr", "t-online.de"]
# Telephone numbers.
PHONE = r"(?<![\w.])(?:\+|00)?\d[\d\s().\-]{6,18}\d(?![\w.])"
PHONE_LABEL = r"(?i)(?:tel|phone|fax|mobile|call|whatsapp|telefon|teléfono|telefono|telf|contatto|mobi|hotline|support)"
# Hosts of social profiles and the key each is kept under.
SOCIAL_HOSTS = {"linkedin.com": "linkedin", "twitter.com": "twitter", "x.com": "twitter", "facebook.com": "facebook", "instagram.com": "instagram", "youtube.com": "youtube", "github.com": "github", "gitlab.com": "gitlab", "medium.com": "medium", "crunchbase.com": "crunchbase", "producthunt.com": "producthunt", "xing.com": "xing", "weibo.com": "weibo", "note.com": "note", "gitee.com": "gitee", "t.me": "telegram", "wa.me": "whatsapp"}
# Legal names and registry numbers.
WECHAT = r"(?i)(?:wechat|weixin|微信|wechat\s*id|weixin\s*id|wx\s*id)\s*[:：=]?\s*([A-Za-z][-_A-Za-z0-9]{5,19})"
JP_LEGAL = r"(?:[゠-ヿ一-鿿㐀-䶿]{2,20}株式会社|株式会社[゠-ヿ一-鿿]{2,20})"
CN_LEGAL = r"[一-鿿]{2,24}?(?:股份有限公司|有限责任公司|有限公司)"
LATIN_LEGAL = (
    r"(?U)\b(?:[A-Z][\w&'’\-\.]*\s+){0,5}[A-Z][\w&'’\-\.]*\s+(?:Ltd\.?|Limited|LLC|Inc\.?|Incorporated|Corp\.?|Corporation|GmbH|mbH|AG|SA|S\.A\.|SAS|SARL|SL|S\.L\.|B\.V\.|N\.V\.|Pty(?:\s+Ltd)?|Pte(?:\s+Ltd)?|AB|Oy|APS"
    r"|S\.p\.?\s*z\s*o\.o\.|s\.r\.o\.|srl|S\.r\.l\.|s\.a\.r\.l\.|d\.o\.o\.|LLC)(?![A-Za-z0-9])"
)
COPYRIGHT = r"(?iU)(?:©|&copy;|copyright)\s*[^0-9\n]{0,10}?((?:[A-Z][\w&'’\-\.]*\s+){1,6}[A-Z][\w&'’\-\.]*)"
REGISTRY_CODES = [
    ("jp_corporate_number", r"(?:法人番号|法人No\.?)\s*[:：]?\s*([0-9]{13})"),
    ("cn_usci", r"统一社会信用代码\s*[:：]?\s*([0-9A-HJ-NPQRTUWXY]{18})"),
    ("de_register", r"(?:HRB|HR|Register(?:gericht)?)\s*[:：]?\s*([0-9]{3,7})\b"),
    ("uk_company_number", r"(?i)(?:Company\s*(?:number|no\.?)|Registered\s+(?:in\s+England|number))\s*[:：]?\s*(?:No\.?\s*)?([0-9]{6,8})\b"),
    ("es_cif", r"\b([A-Z]?[0-9]{7,8}[A-Z]?)\b"),
    ("it_rea", r"(?i)(?:REA|Codice\s+Fiscale)\s*[:：]?\s*([A-Z0-9]{9,16})\b"),
    ("au_abn", r"(?i)\bABN\s*[:：]?\s*([0-9]{2}\s?[0-9]{3}\s?[0-9]{3}\s?[0-9]{3})\b"),
    ("us_ein", r"(?i)\b(?:EIN|Employer\s+Identification)\s*[:：]?\s*([0-9]{2}-[0-9]{7})\b"),
    ("fr_siren", r"(?i)\b(?:SIREN|SIRET)\s*[:：]?\s*([0-9]{9})\b"),
    ("nl_kvk", r"(?i)\b(?:KvK|Kamer\s*van\s*Koophandel)\s*[:：]?\s*([0-9]{8})\b"),
]
# Words of company names that identify nothing.
LEGAL_NOISE = ["ltd", "limited", "inc", "llc", "corp", "corporation", "gmbh", "ag", "sa", "sas", "sarl", "sl", "bv", "nv", "plc", "pty", "pte", "ab", "oy", "aps", "sro", "srl", "doo", "sp", "zoo", "the", "and", "of", "company", "co", "group", "holdings", "holding", "international", "services", "service", "solutions", "technologies", "software", "systems", "consulting", "lab", "labs", "ltda", "sau"]
NAME_NOISE = ["ceo", "cfo", "coo", "cto", "cio", "cmo", "vp", "svp", "evp", "president", "director", "manager", "founder", "owner", "mr", "mrs", "ms", "dr", "prof", "jr", "sr", "ii", "iii"]
# Roles and paths of search queries, and native words by language.
PRIORITY_ROLES = ["founder", "ceo", "owner", "president", "director"]
SITE_PATHS = ["about", "team", "contact", "impressum", "legal", "privacy"]
PEOPLE_TERMS = ["team", "about", "leadership", "founders", "staff", "people"]
LANGUAGES = [
    ("japanese", ["japanese", "ja", "jp", "日本語", "日本"], ["代表取締役", "社長", "創業者", "代表者"]),
    ("chinese", ["chinese", "zh", "cn", "中文", "中国", "简体", "繁體"], ["创始人", "法定代表人", "负责人", "董事长"]),
    ("german", ["german", "de", "deutsch", "Deutschland"], ["Geschäftsführer", "Inhaber", "Gründer", "Vertreter"]),
    ("spanish", ["spanish", "es", "español", "españa", "espana", "latinoamérica"], ["fundador", "director general", "CEO", "representante"]),
    ("italian", ["italian", "it", "italiano", "italia"], ["fondatore", "amministratore delegato", "titolare", "socio fondatore"]),
    ("french", ["french", "fr", "français", "france"], ["fondateur", "PDG", "dirigeant", "gérant"]),
    ("portuguese", ["portuguese", "pt", "português", "portugues", "portugal", "brasil"], ["fundador", "administrador", "gerente", "sócio fundador"]),
    ("dutch", ["dutch", "nl", "nederlands", "nederland"], ["oprichter", "directeur", "eigenaar", "algemeen directeur"]),
]
# Hints of contact pages and forms.
CONTACT_PATHS = ["contact", "kontakt", "contacto", "contatti", "contato", "contactez", "get-in-touch", "getintouch", "reach", "inquiry", "enquiry", "support", "help", "impressum", "about", "hello", "talk", "book", "quote", "reserve", "reservation", "demo", "callback", "sales", "iletisim", "kontakta", "napisz", "pisz", "kontaktuj", "porcontacto", "fale-conosco", "お問い合わせ", "次序", "聯絡", "联系"]
FORM_HINTS = ["form", "contact", "inquiry", "newsletter", "subscribe"]
NOT_CONTACT_FORM = ["cookie", "consent", "gdpr", "ccookie", "cc-consent", "preference", "newsletter", "subscribe", "subscription", "unsubscribe", "mailing", "search", "login", "signin", "sign-in", "log-in", "register", "signup", "sign-up", "account", "password", "recaptcha", "captcha", "comment", "reply", "track", "pixel", "survey", "vote", "rating", "review", "waitlist", "invite", "referral", "affiliate", "collab", "partnership", "demo-request", "logout", "password-reset", "otp"]
FORM_IDENTITY = ["email", "e-mail", "mail", "name=", "your name", "full name", "first name", "phone", "tel", "telefon", "company", "organisation", "organization", "subject", "betreff", "asunto", "oggetto"]
FORM_MESSAGE = ["message", "textarea", "nachricht", "messaggio", "mensaje", "comment", "your message", "how can we help", "tell us", "description", "frage", "お問い合わせ内容", "お問い合わせ", "留言", "咨询"]
FORM_NAMES = ["contact", "inquiry", "enquiry", "reach", "kontakt"]
SEARCH_ENDPOINTS = ["google.", "bing.com/search", "duckduckgo.com", "search?"]
CONTACT_CONTAINERS = ["address", "footer", "contact", "mail", "email", "e-mail", "impressum", "legal-notice", "colophon", "about", " reach out", "kontakt"]
# Words that open titles, and words that make a phrase no person's name.
TITLE_OPENERS = ["founder", "co-founder", "cofounder", "owner", "chief executive officer", "ceo", "chief operating officer", "coo", "chief technology officer", "cto", "chief financial officer", "cfo", "chief information officer", "cio", "chief marketing officer", "cmo", "president", "vice president", "vp", "managing director", "managing partner", "general manager", "head of", "director", "partner", "principal", "manager", "lead", "engineer", "developer", "designer", "consultant", "coordinator", "specialist", "board member", "advisor", "supervisor", "chairman", "chairwoman", "representative director", "executive officer", "senior advisor", "product manager", "product owner", "sales director", "account executive", "business development", "operations manager", "marketing director", "sales", "marketing", "operations", "engineering", "finance", "human resources", "customer success", "communications", "growth", "content", "creative", "app store", "google play", "the developer", "developer of", "代表取締役", "代表取締役社長", "代表取締役ceo", "会長", "社長", "代表", "代表者", "創立者", "創業者", "共同創業者", "法人代表", "cieo", "，愿", "负责人", "创始人", "法定代表人", "董事長", "董事長兼ceo", "執行長", "總經理", "總裁", "viceleiter", "geschäftsführer", "inhaber", "vertreter", "ansprechpartner"]
TITLE_PROSE = r"[.!?;,]|(?:\s(?:and|the|for|with|und|et|y|e|per)\s)"
TITLE_CHROME = r"\s[-–—|]\s.*[-–—|]\s"
ROLE_TOKENS = ["founder", "cofounder", "owner", "ceo", "cfo", "coo", "cto", "cio", "cmo", "president", "vice", "head", "chief", "director", "manager", "lead", "partner", "principal", "engineer", "developer", "designer", "consultant", "coordinator", "specialist", "advisor", "supervisor", "chairman", "chairwoman", "representative", "executive", "officer", "team", "staff"]
PRODUCT_TOKENS = ["management", "system", "systems", "property", "properties", "channel", "channels", "product", "products", "software", "solution", "solutions", "platform", "platforms", "service", "services", "suite", "engine", "booking", "bookings", "reservation", "reservations", "manager", "master", "cloud", "desk", "portal", "panel", "dashboard", "api", "app", "apps", "module", "modules", "edition", "standard", "premium", "basic", "pro", "one", "plus", "lite", "max", "hub", "center", "centre", "office", "operations", "revenue", "yield", "rate", "rates", "inventory", "pms", "vrms", "crm", "erp", "cms"]
SUFFIX_TOKENS = ["co", "cos", "corp", "corps", "inc", "ins", "ltd", "llc", "gmbh", "sarl", "srl", "bv", "bvba", "nv", "ag", "oü", "oy", "ab", "spa", "plc", "llp", "kft", "doo", "d.o.o.", "pte", "pty", "sa", "s.a."]
STACK_TOKENS = ["fonts", "tag", "tags", "performer", "other", "year", "album", "songs", "song", "records", "analysis", "analytics", "stack", "webflow", "cloudflare", "google", "open", "graph", "optimization", "version", "hosting", "database", "url", "http", "https", "ssl", "cdn", "api", "widget", "widgets", "plugin", "font", "track", "tracks", "discography", "genre", "label", "titled", "single", "singles"]
NOT_PERSON_TOKENS = ["privacy", "cookie", "terms", "contact", "about", "home", "search", "login", "sign", "our", "the", "and", "for", "with", "from", "your", "team", "blog", "news", "press", "careers", "jobs", "help", "faq", "support", "services", "products", "pricing", "features", "legal", "impressum", "sitemap", "copyright", "all", "rights", "reserved", "company", "corporation", "group", "international", "solutions", "systems", "technologies", "labs", "studio", "agency", "partners", "capital", "holdings", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "menu", "close", "read", "more", "view", "learn", "get", "start", "free", "trial", "demo", "book", "now", "today", "explore", "discover"]
# Postal addresses: hints of their lines, and their forms.
ADDRESS_HINTS = ["address", "head office", "headquarter", "hq", "office", "located in", "based in", "所在地", "住所", "本社", "地址", "总部"]
LATIN_ADDRESS = r"(?U)\b\d{1,5}\s+[A-Z][\w'’\-]*(?:\s+[A-Z][\w'’\-]*){0,4}\s*,?\s*(?:[A-Z][\w'’\-]*\s*){0,3},?\s*[A-Z]{2}\s+\d{5}(?:-\d{4})?\b"
JP_ADDRESS = r"[一-鿿]{2,8}?[都道府県][一-鿿]{2,8}?[市区町村][一-鿿0-9\-]{2,20}"
CJK_ADDRESS = r"[一-鿿]{2,10}(?:市|区|町|村)[一-鿿0-9\-]{2,20}(?:[0-9]+[-ー丁目\-番地]?[0-9]*)"
# Titles that tie a person to an organisation, and words of departments.
ATTRIBUTION = r"(?iU)\b(?:co-?founder|founder|ceo|owner|director|managing director|president|head|partner|chief executive officer|vice president|general manager)\b[^.!?;]*?\b(?:of|at)\b\s+([\w’'&][\w’'&.\-]*(?:[\s-][\w’'&][\w’'&.\-]*){1,3})"
DEPARTMENTS = ["marketing", "sales", "operations", "engineering", "product", "products", "finance", "financial", "human", "resources", "technology", "information", "legal", "strategy", "strategies", "design", "designs", "growth", "revenue", "development", "business", "customer", "customers", "account", "accounts", "partnership", "partnerships", "people", "support", "security", "data", "delivery", "procurement", "quality", "research", "communications", "public", "relations", "brand", "content", "creative", "it", "services", "service", "solutions", "analytics", "acquisition", "insights", "supply", "chain", "logistics", "compliance", "risk"]
# Endings of hosts that aren't fetched off the company's site, signs of a wall against robots, words that part no names.
UNFETCHED_ENDINGS = ["facebook.com", "instagram.com", "pinterest.com", "x.com", "twitter.com"]
BOT_WALL = ["enable javascript", "please enable javascript", "just a moment", "checking your browser", "cf-browser-verification", "access denied", "are you a robot", "請稍候", "checking your browser before accessing"]
NAME_STOPWORDS = ["the", "and", "of", "for", "ltd", "llc", "inc", "gmbh", "co"]
# Categories of failed results, and the category that a status stands for.
FAILURE_CATEGORIES = ["entity failure", "person failure", "contact failure", "wrong/invalid domain", "insufficient evidence", "technical failure"]
STATUS_CATEGORY = {"FAILED_DOMAIN": "wrong/invalid domain", "FAILED_ENTITY_RESOLUTION": "entity failure", "FAILED_PERSON_DISCOVERY": "person failure", "FAILED_CONTACT_DISCOVERY": "contact failure", "ERROR": "technical failure"}
