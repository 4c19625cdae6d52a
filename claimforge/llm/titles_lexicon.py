"""Spellings of canonical titles in the languages of the corpus: short forms, synonyms, translations.

Keyed by the canonical title, so that identifiers always come from the reference table; a canonical title
without an entry here is matched by its own spelling and its inversions only.
"""

ALIASES = {
    "Founder": "company founder; creator and founder; Gründer; Gründerin; Firmengründer; Firmengründerin; fondateur; fondatrice; fundador; fundadora; 創業者; sogyosha",
    "Co-Founder": "cofounder; co founder; joint founder; Mitgründer; Mitgründerin; cofondateur; cofondatrice; cofundador; cofundadora; 共同創業者",
    "Owner": "business owner; company owner; sole owner; proprietor; Inhaber; Inhaberin; Eigentümer; Eigentümerin; propriétaire; propietario; propietaria; オーナー",
    "Chief Executive Officer": "CEO; chief exec; chief exec. officer; chief executive; Vorstandsvorsitzender; Vorstandsvorsitzende; PDG; président-directeur général; consejero delegado; consejera delegada; 最高経営責任者",
    "Managing Director": "MD; managing dir.; mng. director; Geschäftsführer; Geschäftsführerin; GF; directeur général; directrice générale; director gerente; directora gerente",
    "Representative Director": "rep. director; 代表取締役; daihyo torishimariyaku",
    "Chief Operating Officer": "COO; chief ops officer; chief operations officer; director de operaciones; directora de operaciones; directeur des opérations; directrice des opérations; 最高執行責任者",
    "Chief Financial Officer": "CFO; chief finance officer; Finanzvorstand; directeur financier; directrice financière; director financiero; directora financiera; 最高財務責任者",
    "Chief Technology Officer": "CTO; chief tech officer; chief technical officer; Technikvorstand; directeur technique; directrice technique; director técnico; directora técnica; 最高技術責任者",
    "Chief Information Officer": "CIO; chief info officer; IT-Vorstand; directeur informatique; directrice informatique; DSI",
    "Chief Product Officer": "CPO; chief prod. officer; Produktvorstand; directeur produit; directrice produit; director de producto; directora de producto",
    "Chief Marketing Officer": "CMO; chief mktg officer; Marketingvorstand; directeur marketing; directrice marketing; director de marketing; directora de marketing",
    "President": "company president; président; présidente; presidente; presidenta; Präsident; Präsidentin; 社長; shacho",
    "Vice President": "VP; vice pres.; Vizepräsident; Vizepräsidentin; vice-président; vice-présidente; vicepresidente; vicepresidenta; 副社長",
    "General Manager": "GM; gen. manager; gen mgr; Betriebsleiter; Betriebsleiterin; gerente general; directeur d'exploitation; 総支配人",
    "Managing Partner": "mng. partner; geschäftsführender Gesellschafter; geschäftsführende Gesellschafterin; associé gérant; associée gérante; socio director; socia directora",
    "Branch Manager": "branch mgr; Filialleiter; Filialleiterin; Niederlassungsleiter; Niederlassungsleiterin; chef d'agence; cheffe d'agence; jefe de sucursal; jefa de sucursal; 支店長",
    "Head of Engineering": "head of eng; engineering lead; Leiter Entwicklung; Leiterin Entwicklung; Entwicklungsleiter; Entwicklungsleiterin; responsable d'ingénierie; responsable de ingeniería; jefe de ingeniería; jefa de ingeniería",
    "Head of Design": "design lead; lead of the design team; Leiter Gestaltung; Leiterin Gestaltung; Leiter Design; Leiterin Design; responsable du design; responsable de diseño; jefe de diseño; jefa de diseño",
    "Head of Sales": "sales lead; head of sales dept; Vertriebsleiter; Vertriebsleiterin; responsable commercial; responsable commerciale; responsable des ventes; jefe de ventas; jefa de ventas; 営業部長",
    "Business Development Manager": "BDM; biz dev manager; bus. dev. mgr; business developer manager; développement commercial; responsable développement commercial; desarrollo de negocio; Leiter Geschäftsentwicklung; Leiterin Geschäftsentwicklung",
    "Head of Partnerships": "partnerships lead; head of partner relations; Leiter Partnerschaften; Leiterin Partnerschaften; responsable des partenariats; responsable de alianzas",
    "Account Executive": "AE; account exec.; acct exec; ejecutivo de cuentas; ejecutiva de cuentas; chargé de clientèle; chargée de clientèle; Kundenberater; Kundenberaterin",
    "Key Account Manager": "KAM; key acct mgr; Großkundenbetreuer; Großkundenbetreuerin; responsable grands comptes; responsable comptes clés; gestor de grandes cuentas; gestora de grandes cuentas",
    "Product Manager": "prod. manager; product mgr; PM (product); Produktmanager; Produktmanagerin; chef de produit; cheffe de produit; jefe de producto; jefa de producto; プロダクトマネージャー",
    "Product Owner": "PO; prod. owner; agile product owner; responsable produit; Produktverantwortlicher; Produktverantwortliche",
    "Operations Manager": "ops manager; ops mgr; gerente de operaciones; responsable des opérations; responsable de operaciones; Leiter Betrieb",
    "Office Manager": "office mgr; Büroleiter; Büroleiterin; Büroleitung; responsable de bureau; jefe de oficina; jefa de oficina",
    "Supply Chain Manager": "SCM lead; supply-chain mgr; Leiter Lieferkette; Leiterin Lieferkette; responsable logistique; responsable de la chaîne d'approvisionnement; jefe de logística; jefa de logística",
    "Marketing Manager": "mkt. mgr; mktg manager; Marketingleiter; Marketingleiterin; responsable marketing; responsable de marketing; jefe de marketing; jefa de marketing",
    "Growth Lead": "growth mgr; growth manager; head of growth; growth hacker in chief; responsable croissance; responsable de crecimiento; Leiter Wachstum; Leiterin Wachstum",
    "Communications Manager": "comms manager; PR manager; Pressesprecher; Pressesprecherin; chargé de communication; chargée de communication; responsable communication; responsable de comunicación; 広報担当",
    "Board Member": "member of the board; Aufsichtsrat; Aufsichtsrätin; membre du conseil; consejero; consejera; miembro del consejo; 取締役",
    "Advisor": "adviser; strategic advisor; strategic adviser; Berater des Vorstands; Beraterin des Vorstands; asesor; asesora; conseiller; conseillère; 顧問",
    "Investor": "angel investor; Investorin; investisseur; investisseuse; inversor; inversora; 投資家",
    "Software Engineer": "SWE; software eng.; software developer; Softwareentwickler; Softwareentwicklerin; ingénieur logiciel; ingénieure logiciel; développeur logiciel; développeuse logiciel; desarrollador de software; desarrolladora de software; ソフトウェアエンジニア",
    "Data Analyst": "data anlst; Datenanalyst; Datenanalystin; analyste de données; analista de datos; データアナリスト",
    "Customer Support Specialist": "cust. support spec.; support agent; support specialist; Kundenbetreuer; Kundenbetreuerin; conseiller clientèle; conseillère clientèle; atención al cliente; agente de soporte",
    "Project Coordinator": "proj. coordinator; Projektkoordinator; Projektkoordinatorin; coordinateur de projet; coordinatrice de projet; coordinador de proyectos; coordinadora de proyectos",
    "Accountant": "bookkeeper / accountant; bookkeeper; Buchhalter; Buchhalterin; comptable; contable; 経理担当",
    "Human Resources Manager": "HR manager; HR mgr; Personalleiter; Personalleiterin; DRH; responsable des ressources humaines; jefe de recursos humanos; jefa de recursos humanos; 人事部長",
    "Legal Counsel": "in-house lawyer; in-house counsel; Justiziar; Justiziarin; juriste d'entreprise; asesor jurídico; asesora jurídica; 法務担当",
}


def spellings() -> list[tuple[str, str]]:
    """(canonical title, spelling), with the title itself and, for German, the spelling without umlauts."""
    pairs = []
    for title, text in ALIASES.items():
        for spelling in [title, *text.split("; ")]:
            pairs.append((title, spelling))
            plain = spelling
            for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue")):
                plain = plain.replace(a, b)
            if plain != spelling:
                pairs.append((title, plain))
    return pairs
