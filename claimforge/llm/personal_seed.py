"""The small labelled table for personal details: sentences made from templates, with invented people, places and firms.

In a template {name}, {last}, {email}, {phone}, {id} and {address} are labelled; {place}, {firm}, {n}, {year}, {date}, {vat}, {order},
{role} and {thing} are not. Everything is drawn with a fixed seed, so the table is the same everywhere.
"""

from __future__ import annotations

import random

GIVEN = (
    "Anna Maria Peter Paul Laura Sophie Emma Liam Noah Olivia Lucas Felix Hannah Karl Greta Otto Ida Erik Lars Astrid Freya Nils Henrik Sigrid Ola Kari Matteo Chiara Luca Giulia Marco Elena Paolo Bianca Pierre Claire Luc "
    "Camille Hélène Gérard Sébastien Amélie Benoît Élodie Carlos Lucía Javier Sofía Álvaro Inés Raúl Belén Íñigo Zoë Chloé Jörg Günther Käthe Jana Petra Ivan Olga Dmitri Irina Nikos Eleni Yiannis Aisha Fatima Hassan Ravi Anjali Arjun "
    "Mei Ling Kenji Yuki Haruto Sakura Jin Min David Sarah James Mary John Linda Daniel Karen Susan George Ruth Frank Alice Henry Grace Oliver Lucy Jack Ella Harry Mia Leo Nina Max Eva Simon Julia Martin Andrea Stefan Monika Jan Eliza "
    "Susanne Edward Samuel Katherine Ángela Ulrike Francisco Hugo Nicholas Helena Friedrich José Johannes Beatriz Jürgen Margaret Mónica Thomas Rebecca Elizabeth Michael Alexander Ingrid Tobias Benjamin Anthony William Katharina Giuseppe "
    "Patricia Lukas Theodore Dolores Zoltan Jennifer Victoria Deborah Joachim Christopher Gregory Ignacio Marlene Clara Robert Yvonne Amara Wanda Søren Oscar André Sven Priya Björn Omar Nadia Renée Noëlle Fergus Quentin François"
).split()
HEADS = "Hal Mor Brand Stein Vel Quar Lind Berg Fos Hart Wel Kess Mar Ros Dun Ash Thorn Green Wal Hol Kar Nor Sand Vin Tol Bren Cal Dor El Fern Gal Hamp Ing Kel Lan Mal Oster Pell Ras Sund Tam Ul Win Yarr Zell Mül Grön Peñ Léb Køst".split()
TAILS = "ström berg sen son ley ton man wick ski dottir ini etti ez aldo ova enko quist rand holm ander ault ier oval iver ington bach stad orth moor ellan ikson usko aldi over essier udo mann by gan ero".split()
KANJI_LAST = ["佐藤", "鈴木", "高橋", "田中", "伊藤", "渡辺", "山本", "中村", "小林", "加藤", "吉田", "山田", "佐々木", "山口", "松本", "井上", "木村", "林", "清水", "長谷川", "石川", "前田", "藤田", "岡本", "水野", "荒井", "桜井", "小野寺", "五十嵐", "稲葉", "岩田", "鷹野", "古川", "桃井", "藍沢", "大久保", "久保田", "小鹿野", "森田", "田所", "村井"]
KANJI_FIRST = ["太郎", "花子", "一郎", "健", "誠", "翔", "大輔", "美咲", "陽菜", "結衣", "凛", "葵", "悠斗", "真由", "千春", "和也", "聡", "香織", "直樹", "恵", "沙織", "巌", "徹", "里穂", "健二", "聡美", "悠", "真央", "織江", "岳", "蓮", "月子", "光帆"]
PLACE_HEADS = "Ald Hem Wend Rok Saint Port Norr Lund Kirk Gold Bram Val Puerto Bad Neu Ober San Santa Villa Stone Black Fair Ember Oster Castel Riva".split()
PLACE_TAILS = "ville burg ton ham dorf mouth haven field vale bridge stadt mar monte rosa luz sund hausen moor delle mira quay".split()
SECTORS = "Travel Timber Hotel Clinic Glass Energy Marine Freight Catering Rail Robotics Packaging Payroll Textile Analytics Harbour Booking Software Systems Logistics Foods Media Tools Garden Bikes".split()
LEGAL = ["Ltd", "Inc", "GmbH", "AG", "SARL", "S.A.", "LLC", "PLC", "S.L.", "K.K.", "& Co. KG", "& Sons Ltd", "Group"]
ROADS = "Street St. Road Rd. Lane Avenue Ave Ave. Court Blvd Row Drive Close Way Square Terrace Place".split()
ROLES = "managing director|head of operations|finance lead|founder|depot manager|chief engineer|buyer|owner|Geschäftsführer|Werkleiter|Leiterin Einkauf|directrice des achats|chef de dépôt|fondateur|jefa de planta|directora de compras|fundador|head of sales|press officer|project coordinator".split("|")
THINGS = "the new ferry|a cold store|the booking desk|the kiln|our packing hall|the second pier|a pallet lift|the night train|the seat plan|a small workshop".split("|")

TEMPLATES = """
{name} joined the firm in {year} and runs the {place} office.
{name}, {role} of {firm}, presented the plan to the staff.
{name}, {role} of {firm}, opened {thing} in {place}.
Questions about {thing} went to {name} and were answered the same day.
The talk was given by {name}.
Minutes were taken by {name}.
Thanks to {name} for the photographs.
Photographs by {name}.
"We were late, and we knew it," says {name}.
"It works," said {name} in {place}.
- {name}
Hired: {name} ({role})
Contact: {name} | {email} | {phone}
Contact: {name}, {phone}, {email}
Contact {name} at {firm} for details.
According to Dr. {last}, the matter is settled.
According to Ms {last}, the matter is settled.
According to Prof. {last}, nothing has changed.
Mr {last} declined to comment.
Mrs. {last} will retire in {year}.
Miss {last} and Mr. {last} met in {place}.
Prof. Dr. {name} read from the report.
Dear {name}, your order {order} has left {place}.
Interview with {name}, {role}
By {name}, {date}
Best regards, {name}, {role}, {address}, {place}, T {phone}, {email}
Kind regards {name} {role} {firm} {address} {place} {phone}
{"contact": "{name}", "mail": "{email}", "tel": "{phone}"}
{"name": "{name}", "phone": "{phone}"}
name={name};phone={phone};mail={email}
| {name} | {email} | {phone} |
Write to {email} for the full report.
Write to {email} or call {phone}.
Contact <{email}> before the end of the month.
You can also reach the desk under {email}.
Applications go to {email}, please without photographs.
E-mail: {email}
mailto:{email}
Mail {email} and ask for {name}.
Send it to {email} by {date}.
Tel: {phone}
Phone/Fax {phone}
Fax {phone}
Hotline {phone}, open day and night.
The desk answers under {phone} until 18:00.
Call {phone} on weekdays.
Text me on {phone} if you are late.
Mobile {phone} E-mail {email}
Ring us on {phone} or visit {address}.
SSN: {id}
Passport no. {id} was shown at the door.
Identity card {id}, issued in {place}.
His national insurance number is {id}.
The form lists her tax id as {id}.
Tax number {id} belongs to the applicant.
Driving licence {id} was found near {place}.
ID number {id}
Visitors: {address}, second floor, {place}
The workshop is at {address}.
Letters reach us at {address}, {place}.
Deliver to {address} before noon.
She moved to {address} in {year}.
He lives at {address}.
Our office: {address}, {place}
Meet {name} at {address}.
VAT no. {vat}, registry file B-{n}.
Invoice {order} has been settled.
Order {order} was the first {place} delivery.
Part number {order} fits all models.
Meet us at the corner of Hall B, stand {n}-{n}.
Room {n}, {place} hall, bring your own cup.
Our server at 192.0.2.{n} was replaced in {year}.
Opening hours 09:30-17:00, closed on {date}.
She arrived at 14:05 and left at 15:10.
Aspect ratio 16:9, resolution 1920x1080, build {n}.{n}.
Coordinates {n}.{n}, {n}.{n}
{firm} was registered in {year} and has kept its seat in {place} ever since.
{firm} bought its tools and kept {n} of the staff.
The firm of {last} & Sons Ltd supplied the glass.
The {last} & Co. yard in {place} closed in {year}.
{last} Brothers Ltd built {thing}.
Nobody at {firm} expected that rail operators would use it.
When the supplier in {place} closed, {firm} opened a depot outside {place}.
{place}, {date}: {firm} rebuilt {thing} for glass makers.
In {year} the firm opened a seasonal depot outside {place} and hired {n} people for it.
Version {n}.{n}.{n} of the tide model adds a quiet view that clinics had requested.
The board approved {n},{n} for a kiln, to be finished before {year}.
Revenue reached {n},{n} after tour agencies renewed their contracts.
Follow the team as @harbourdesk on any network.
Full time / {place} / ref {n}-{n}
Founded: {year} | Staff: {n} | Seat: {place}
Since {year} the accounts are checked by an office in {place} that has no other tie to {firm}.
https://docs.harbour.example/v2/rates?from={n}&to={n}#top
FOR IMMEDIATE RELEASE - {firm} rebuilt {thing}
Shares were not traded when the news broke.
How did {firm} get to {place}?
| basic | {n} |
SELECT id, net FROM rates WHERE net > {n};
File {n}, sheet {n}: {firm}, seat {place}, entered {year}.
Our plans for {place} and {place}
Listed since {year}, last checked {year}.
About the company: {firm} has supplied harbour offices since {year}.
{name} leitet seit {year} das Büro in {place}.
{name}, {role} bei {firm}, stellte den Plan vor.
Ansprechpartner ist {name}.
Ansprechpartnerin: {name}, {phone}
Protokoll: {name}
Text und Bild: {name}
Das Gespräch führte {name}.
Frau {last} wollte sich dazu nicht äußern.
Herr {last} war nicht zu erreichen.
Herr Dr. {last} und Frau {last} kamen aus {place}.
Mit freundlichen Grüßen {name}, {address}, {place}, Tel. {phone}, {email}
Viele Grüße, {name}
Kontakt: {name}, {phone}, {email}
Schreiben Sie an {email}.
Bewerbungen bitte an {email} senden.
Sie erreichen uns unter {phone}.
Rufen Sie {phone} an.
Telefon: {phone}
Mobil {phone}
Fax {phone}
E-Mail: {email}
Steuer-ID {id}
Ausweisnummer: {id}
Sozialversicherungsnummer {id}
Im Antrag steht die Nummer {id} des Personalausweises.
Der Reisepass {id} wurde in {place} ausgestellt.
Lieferung an {address}.
Das Büro liegt {address}, {place}.
Anschrift: {address}, {place}
Besuchen Sie uns: {address}
USt-IdNr. {vat}, HRB {n}
Artikel {n}-{n} ist lieferbar.
Rechnung {order} ist bezahlt.
Geöffnet 08:00-16:30, am {date} geschlossen.
Die {last} & Co. KG lieferte das Glas.
Im Jahr {year} eröffnete die Firma ein Lager bei {place} und stellte {n} Leute ein.
{firm} hat das Frachtportal für Kliniken in {place} erweitert.
Niemand bei {firm} hatte erwartet, dass Bahnbetreiber es nachts brauchen.
Der Umsatz stieg nach {year} auf {n},{n} Euro.
Ersatzteile liegen in {place} und sind am nächsten Morgen vor Ort.
Zwischen {place} und {place}
Warum Kliniken in {place} wechseln
Über {firm}: Das Unternehmen wurde {year} gegründet.
Depuis {year}, {name} dirige le bureau de {place}.
{name}, {role} de {firm}, a présenté le projet.
L'entretien a été accordé par {name}.
Compte rendu : {name}
M. {last} n'a pas souhaité répondre.
Mme {last} a quitté {place} en {year}.
Selon le Dr {last}, tout est prêt.
Cordialement, {name}, {address}, {place}, tél. {phone}, {email}
Contact : {name}, {phone}, {email}
Écrivez à {email}.
Les candidatures sont à envoyer à {email}.
Courriel : {email}
Tél. : {phone}
Portable {phone}
Appelez le {phone} en semaine.
Joignez-nous au {phone}.
Numéro de sécurité sociale {id}
Carte d'identité {id}, délivrée à {place}.
Numéro fiscal {id}
Passeport n° {id}
Adresse : {address}
Livraison au {address} avant midi.
Le bureau se trouve {address}, à {place}.
RCS {place} B {n} {n}
RCS {place} B {n} {n} En {year}, la société a recruté {n} personnes.
Visiteurs : {address}, {place}
SSN: {id}
Social security number {id} is on file.
Her passport {id} expired in {year}.
Steuer-ID {id} liegt vor.
Personalausweis Nr. {id}
Commande {order} livrée.
TVA {vat}
Ouvert de 09:00 à 18:00.
En {year}, la société a ouvert un dépôt près de {place} et recruté {n} personnes.
Personne chez {firm} ne pensait que les cliniques l'utiliseraient la nuit.
{firm} a étendu son portail pour les hôtels de {place}.
Pourquoi les vergers de {place} changent
Entre {place} et {place}
La maison {last} & Fils a livré le verre.
Desde {year}, {name} dirige la oficina de {place}.
{name}, {role} de {firm}, presentó el plan.
La entrevista la concedió {name}.
Acta: {name}
La señora {last} no quiso hacer declaraciones.
El señor {last} llegó a {place} en {year}.
Sra. {last} y Sr. {last}
Un saludo, {name}, {address}, {place}, tel. {phone}, {email}
Contacto: {name} / {phone} / {email}
Escriba a {email}.
Las candidaturas se envían a {email}.
Correo: {email}
Teléfono: {phone}
Móvil {phone}
Llame al {phone} por las mañanas.
Llámenos al {phone}.
DNI {id}
NIE: {id}
El pasaporte {id} se entregó en {place}.
Número de la seguridad social {id}
Entrega en {address} antes del mediodía.
La oficina está en {address}, {place}.
Dirección: {address}
CIF B-{n}, inscrita en {year}.
Pedido {order} entregado.
NIF de la empresa {vat}
Horario 09:00-14:00.
En {year} la empresa abrió un almacén cerca de {place} y contrató a {n} personas.
Nadie en {firm} esperaba que los clínicas lo usaran de noche.
{firm} revisó su calendario para hoteles de {place}.
Por qué cambian los clínicas de {place}
Cristalería {last} e Hijos S.L. entregó el vidrio.
担当は{jname}です。
担当者：{jname}
講演者 {jname}
{jrole}の{jname}氏が計画を説明しました。
{jlast}さんは回答を控えました。
{jlast}氏によると、問題はありません。
連絡先 {jname} {phone} {email}
{jname} {jaddress} 電話 {phone} {email}
{jname} {jaddress} 電話 {phone} {email}
{jname} {jaddress} 電話 {phone}
連絡先 {jname} {jaddress}
{jrole}の{jname}氏が発表しました。
講演者 {jname}
お問い合わせは {email} まで。
メール: {email}
電話 {phone}
受付 {phone} 平日のみ
旅券番号 {id}
個人番号 {id}
所在地は{jaddress}です。
住所 {jaddress} {place}
お届け先 {jaddress}
法人番号 {n}-{n}
営業時間 09:00-17:30
{firm}は鉄道事業者向けの料金カレンダーを拡張しました。
{year}年に{place}近郊に倉庫を開設し、{n}名を採用しました。
{year}年の売上は{n},{n}円に達しました。
{place}と{place}の実績
紙不要の貨物ポータルは{n}か所で利用されています。
導入前は港湾事務所が手作業で月{n}時間を費やしていました。
共有型の予約管理を果樹農家が選ぶ理由
Компания {firm} расширила свои услуги для клиник.
До {year} года списки для клиник вели вручную.
Контакт: {name}, {phone}
{place} и {place}: итоги {year} года
Η {firm} ανανέωσε τις υπηρεσίες της για κλινικές.
Επικοινωνία: {name}, {email}
Share capital {n},{n}.
Share capital {n}00.
Budget: {n},{n} for {year}, {n}00 for the year after.
Accounts for {year} filed, {n} pages.
Amended {year}: the seat was moved to {place}.
Hours: {n} a month, start in {year} or by agreement.
Of every hundred calls from {place}, {n} end without a transfer.
Training takes {n} minutes, and glass makers can repeat it as often as they like.
The quiet plan costs less than {n},{n} a year and can be ended at any time.
Plans to sell the index beyond {place} were dropped in {year} and taken up again later.
From {place} the crew serves hotels across {n} postcodes, mostly with a seasonal fleet.
An independent review found {n} minor issues and no serious one.
What we do for tour agencies in {place}
Prices of the seat map in {place}
There was a mistake at first. Version {n} put it right.
We looked at {place}. Nothing had changed at all. It was late.
{place}, {date} - {firm} opened a shared office.
Built in {n} nights by a team of {n} in {place}.
Der Umsatz mit dem Modul stieg nach {year} auf {n} Euro.
Die Prüfung fand {n} kleine Mängel, die {firm} noch {year} behob.
Die Einführung dauerte {n} Tage und verlief ohne größere Störungen.
Früher führten Hafenämter diese Listen von Hand und verloren {n} Stunden im Monat.
Für Reisebüros gibt es eine günstige Ausgabe, die ohne Netz weiterläuft.
Eine gemeinsame Schulung in {place} bereitet Obstbauern auf das Modul vor.
Das Buchungssystem kostet je nach Größe zwischen {n} und {n} Euro im Jahr.
Seit {year} nutzen {n} Betriebe den Sensor täglich, die meisten davon in {place}.
Von hundert Anfragen aus {place} werden {n} ohne Rückfrage erledigt.
Der Neue Markt in {place} bekommt eine Große Halle und ein Kleines Haus.
Unser Team, der Vorstand und die Leitung danken der Stadt {place}.
Preiskalender für Familienhotels in {place}
{place}: Ergebnisse seit {year} mit Dienstplan
Le chiffre d'affaires du module a atteint {n} euros après {year}.
Plus de {n} sites utilisent aujourd'hui le portail sans papier.
Sur cent appels des vergers, {n} aboutissent sans attente.
La formation dure {n} minutes et se déroule à {place}.
L'essai mené avec {n} équipes s'est achevé en {year} à {place}.
Les pièces du portail sont gardées à {place} et livrées le lendemain.
Los ingresos del módulo llegaron a {n} euros después de {year}.
Más de {n} centros usan hoy el portal sin papel ni llamadas.
De cada cien llamadas, {n} se resuelven sin espera.
La formación dura {n} minutos y se puede repetir en {place}.
Los repuestos del portal se guardan en {place} y llegan a la mañana siguiente.
研修は{n}分で、{place}でも受講できます。
研修は{n}分で、{place}でも受講できます。
給与計算は{n}か所で利用されています。
夜間向けの予約管理は{n}か所で利用されています。
{year}年に{place}近郊に倉庫を開設し、{n}名を採用しました。
{place}の{n}名が{n}台を{n}円で購入しました。
Το {year} άνοιξε μια αποθήκη και προσέλαβε {n} άτομα.
"""
JROLES = ["代表", "部長", "課長", "社長", "店長", "担当者"]
JTOWNS = ["本町", "中央", "緑ヶ丘", "青葉台", "桜通", "鷹野通", "水神台", "若松町", "稲荷町", "港町", "旭丘", "北浜", "青山", "大手通", "森の里", "東雲台"]


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def last(self) -> str:
        r = self.r
        one = lambda: r.choice(HEADS) + r.choice(TAILS)
        name = one() + ("-" + one() if r.random() < 0.12 else "")
        return name.upper() if r.random() < 0.06 else name

    def name(self) -> str:
        r = self.r
        first, last = r.choice(GIVEN), self.last()
        kind = r.random()
        if kind < 0.66:
            text = f"{first} {last}"
        elif kind < 0.76:
            text = f"{first} {r.choice('ABCDEFGHJKLMPRST')}. {last}"
        elif kind < 0.86:
            text = f"{last}, {first}"
        elif kind < 0.95:
            text = f"{first[0]}. {last}"
        else:
            text = f"{first} {r.choice(GIVEN)} {last}"
        return text.upper() if r.random() < 0.08 else text

    def email(self) -> str:
        r = self.r
        plain = lambda s: s.lower().replace("ü", "ue").replace("ö", "oe").replace("ø", "oe").replace("é", "e").replace("ñ", "n").replace("ë", "e").replace("ç", "c").replace("á", "a").replace("í", "i").replace("ó", "o").replace("-", "")
        first = plain(r.choice(GIVEN)).encode("ascii", "ignore").decode() or "ann"
        last = plain(r.choice(HEADS) + r.choice(TAILS)).encode("ascii", "ignore").decode() or "moor"
        local = r.choice([first, last, f"{first}.{last}", f"{first[0]}{last}", f"{first[0]}.{last}", f"{last}.{first}", f"{first}_{last}", f"{first}.{last}+news", "info", "office", "press", "sales", "jobs.team", "contact", "hello", f"{last}-{first}", f"{first}{r.randint(1, 99)}"])
        host = plain(r.choice(HEADS) + r.choice(TAILS)).encode("ascii", "ignore").decode() + r.choice(["", "", "", "-group", "-" + r.choice(SECTORS).lower(), r.choice(SECTORS).lower()])
        top = r.choice(["example", "example", "example", "com", "org", "de", "co.uk", "net"])
        at = r.choice(["@"] * 9 + ["(at)", " (at) ", "[at]", " [at] ", " AT ", " at ", "[@]", " @ ", " {at} "])
        dot = "." if at == "@" or r.random() < 0.5 else r.choice(["(dot)", " [dot] ", " dot ", " (dot) "])
        text = f"{local}{at}{r.choice(['', '', '', 'mail.'])}{host}{dot}{top}"
        return r.choice([text] * 8 + [text.upper(), text.title()])

    def phone(self) -> str:
        r = self.r
        d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
        return r.choice(
            [
                f"+1 {d(3)} 555 01{d(2)}", f"+1-{d(3)}-555-01{d(2)}", f"+1{d(3)}55501{d(2)}", f"({d(3)}) 555-01{d(2)}", f"{d(3)}-555-01{d(2)}", f"{d(3)}.555.01{d(2)}", f"1 ({d(3)}) 555 01{d(2)}",
                f"+44 20 7946 0{d(3)}", f"020 7946 0{d(3)}", f"+44 (0)1632 960{d(3)}", f"01632 960{d(3)}", f"(01632) 960 {d(3)}", f"0044 1632 960{d(3)}", f"+44 7700 900{d(3)}", f"07700 900{d(3)}",
                f"+49 30 23125{d(3)}", f"+49 (0)30 23125-{d(3)}", f"030 23125 {d(3)}", f"(030) 23 125 {d(3)}", f"030/23125-{d(3)}", f"0049 30 23125 {d(3)}", f"+49 89 {d(6)}", f"0{d(3)} / {d(3)} {d(4)}",
                f"01 99 00 {d(2)} {d(2)}", f"01-99-00-{d(2)}-{d(2)}", f"01.99.00.{d(2)}.{d(2)}", f"+33 1 99 00 {d(2)} {d(2)}", f"+33 (0)6 39 98 {d(2)} {d(2)}", f"06 39 98 {d(2)} {d(2)}", f"+34 9{d(2)} {d(3)} {d(3)}", f"9{d(2)} {d(2)} {d(2)} {d(2)}",
                f"03-{d(4)}-{d(4)}", f"+81 3 {d(4)} {d(4)}", f"0{d(2)}-{d(4)}-{d(4)}", f"+7 495 {d(3)}-{d(2)}-{d(2)}",
            ]
        )

    def id(self) -> str:
        r = self.r
        d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
        c = lambda n=1: "".join(r.choice("ABCDEFGHJKLMNPRSTXYZ") for _ in range(n))
        return r.choice(
            [
                f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{r.choice(['QQ', 'ZZ', 'AB'])}{d(6)}{r.choice('ABCD')}", f"{r.choice(['QQ', 'ZZ'])} {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}", f"{c()}{d(8)}", f"{c()}{d(7)}", f"{d(8)}{c()}",
                f"{r.choice('XYZ')}{d(7)}{c()}", f"{r.choice('XYZ')}-{d(7)}-{c()}", f"{d(2)} {d(3)} {d(3)} {d(3)}", d(11), d(13), f"{d(1)} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", f"{d(4)} {d(4)} {d(4)}", f"{c(2)}{d(7)}", f"{d(8)}-{c()}", f"{c()} {d(8)}", d(9), d(10),
            ]
        )

    def address(self) -> str:
        r = self.r
        n = f"{r.randint(1, 399)}{r.choice([''] * 9 + ['a', 'b'])}"
        street = r.choice(HEADS).replace("-", "") + r.choice(["gate", "field", "ells", "er", "more", "hill", "ock", "den"]) if r.random() < 0.4 else r.choice(["Hill", "Mill", "Sand", "Oak", "Elm", "King", "Lark", "Pinn", "Wither", "Fern", "Brind", "Merrow", "Oster", "Toll", "Quarr", "Kel"]) + r.choice(["", "field", "gate", "hill", "den", "more", "ank", "astle", "ell", "brook", "ock", "ey", "croft"])
        small = street.lower()
        return r.choice(
            [
                f"{n} {street} {r.choice(ROADS)}", f"{n} {street} {r.choice(ROADS)}", f"{n} {street} {r.choice(ROADS)}",
                f"{street}{r.choice(['straße', 'strasse', 'weg', 'gasse', 'platz', 'allee', 'str.'])} {n}", f"{r.choice(['Am', 'An der', 'Im'])} {street}{r.choice(['berg', 'tor', 'platz'])} {n}", f"{street}{r.choice(['weg', 'straße'])} {n}",
                f"{n}{r.choice(['', ',', ' bis', ' bis,', ' ter'])} {r.choice(['rue', 'avenue', 'boulevard', 'chemin', 'place', 'rue de la', 'chemin des', 'rue des', 'allée des'])} {street}{r.choice(['', 's'])}",
                f"{n}, {r.choice(['rue', 'avenue', 'boulevard'])} {street}",
                f"{r.choice(['Calle', 'C/', 'Avenida de', 'Plaza', 'Paseo de', 'Avenida', 'Camino de'])} {street}{r.choice(['', ','])} {n}", f"{r.choice(['Calle', 'C/', 'Avenida de'])} {small.title()} {n}", f"C/ {street}, {n}", f"C/ {street} {n}",
            ]
        )

    def jname(self) -> str:
        return self.r.choice(KANJI_LAST) + self.r.choice(["", "", " "]) + self.r.choice(KANJI_FIRST)

    def jlast(self) -> str:
        return self.r.choice(KANJI_LAST)

    def jaddress(self) -> str:
        r = self.r
        head = r.choice(["", r.choice(KANJI_LAST)[:2]])
        return head + r.choice(JTOWNS) + "-".join(str(r.randint(1, 20)) for _ in range(r.choice([2, 3, 3])))

    def place(self) -> str:
        r = self.r
        kind = r.random()
        if kind < 0.5:
            return r.choice(PLACE_HEADS) + r.choice(PLACE_TAILS)
        a, b = r.choice(PLACE_HEADS), (r.choice(PLACE_HEADS) + r.choice(PLACE_TAILS))
        return f"{a} {b.title()}" if kind < 0.8 else f"{a}-{b.title()}" if kind < 0.9 else f"{a}{r.choice(PLACE_TAILS)} {r.choice(PLACE_TAILS).title()}"

    def firm(self) -> str:
        r = self.r
        brand = "".join(r.choice(["zor", "bel", "fan", "mo", "ri", "ka", "tel", "vu", "san", "do", "pi", "gor", "lu", "ne", "stor", "bran"]) for _ in range(r.randint(3, 4))).title()
        return r.choice([f"{brand} {r.choice(SECTORS)}"] * 4 + [f"{brand} {r.choice(SECTORS)} {r.choice(SECTORS)} {r.choice(LEGAL)}", f"{brand}{r.choice(['24', 'hub', 'ify', 'park', 'wise'])}", f"The {brand} {r.choice(SECTORS)} {r.choice(LEGAL)}", f"{self.last()} {r.choice(SECTORS)} {r.choice(LEGAL)}", f"{brand} {r.choice(SECTORS)}".upper()])

    def fill(self, slot: str) -> str:
        r = self.r
        if slot in ("name", "last", "email", "phone", "id", "address", "jname", "jlast", "jaddress", "place", "firm"):
            return getattr(self, slot)()
        if slot == "n":
            return str(r.choice([r.randint(1, 9), r.randint(10, 999), r.randint(1000, 99999)]))
        if slot == "year":
            return str(r.randint(2008, 2025))
        if slot == "date":
            y, m, d = r.randint(2010, 2025), r.randint(1, 12), r.randint(1, 28)
            return r.choice([f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y}", f"{d:02}/{m:02}/{y}"])
        if slot == "vat":
            return r.choice([f"ZZ 999 {r.randint(1, 999)} 0{r.randint(0, 9)}", f"DE{r.randint(10**8, 10**9)}", f"GB {r.randint(100, 999)} {r.randint(1000, 9999)} {r.randint(10, 99)}"])
        if slot == "order":
            return r.choice([f"ORD-{r.randint(2010, 2024)}-{r.randint(1, 999)}", f"{r.randint(2010, 2024)}-0{r.randint(1, 999)}-{r.randint(1, 999)}", f"{r.randint(2010, 2024)}/{r.randint(1, 999)}", f"7700-{r.randint(1, 999)}-{r.randint(1, 99)}", str(r.randint(10**5, 10**6))])
        return r.choice({"role": ROLES, "thing": THINGS, "jrole": JROLES}[slot])


KIND = {"name": "name", "last": "name", "jname": "name", "jlast": "name", "email": "email", "phone": "phone", "id": "id_number", "address": "address", "jaddress": "address"}
UNLABELLED_BEFORE = (" & ", " Brothers", " e Hijos")


def sentences(repeats: int, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, spans): every template filled repeats times; a third are joined with their neighbour, as in running text."""
    import re

    maker = Maker(seed)
    slot = re.compile(r"\{([a-z]+)\}")
    out: list[tuple[str, list[tuple[int, int, str]]]] = []
    for template in TEMPLATES.strip().split("\n"):
        for _ in range(repeats):
            text, spans, at = "", [], 0
            for m in slot.finditer(template):
                text += template[at : m.start()]
                value = maker.fill(m[1])
                kind = KIND.get(m[1])
                if kind and not (m[1] == "last" and template[m.end() :].startswith(UNLABELLED_BEFORE)):
                    spans.append((len(text), len(text) + len(value), kind))
                text += value
                at = m.end()
            out.append((text + template[at:], spans))
    maker.r.shuffle(out)
    joined = []
    for i, (text, spans) in enumerate(out):
        if i % 3 == 0 and i + 1 < len(out):
            other, more = out[i + 1]
            gap = maker.r.choice([" ", "\n", " "])
            if "\u3040" <= text[-1] <= "\u9fff" or text[-1] == "。" or re.match("[\u3040-\u9fff]", other):
                gap = maker.r.choice(["", "", gap])  # no spaces part sentences there
            shift = len(text) + len(gap)
            joined.append((text + gap + other, spans + [(a + shift, b + shift, k) for a, b, k in more]))
        elif i % 3 != 1:
            joined.append((text, spans))
    return joined
