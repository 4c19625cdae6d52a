"""A small labelled table of invented pages: one block per line, "-" furniture, "+" main body, "@" before linked text.

It is always part of the training table; pages of the corpus whose markup names its regions (nav, main, aside,
footer) are added up to a documented bound.
"""

PAGES = """
-@Home
-@Products
-@Pricing
-@Careers
-@Sign in
-You are here: Home / Products
+How the night ferry learned to wait
+By Dana Quell, 3 May 2021
+The ferry leaves at nine and waits for the last train if the guard rings the bell. Since last spring the bell is a message on a screen, and nobody has missed the boat.
+All times are local and were checked in May.
+Tickets are sold on board and at the kiosk by the pier. Bicycles travel free of charge on weekdays, and dogs always do.
-Share this page
-Was this page helpful? Yes No
-Related articles
-@A short history of the pier
-@Timetables for the winter
-© 2021 Quell Ferries. All rights reserved.
-Privacy policy
-Back to top
-We use cookies to count visits. Accept all | Only necessary | Settings

-@Startseite
-@Produkte
-@Kontakt
-@Über uns
+Unser Lager zieht um
+Von Ada Brendel, 11.03.2020
+Das neue Lager liegt direkt am Kanal und hat drei Tore. Der Umzug dauert zwei Wochen, in dieser Zeit liefern wir aus der alten Halle.
+Angaben ohne Gewähr.
-Seite drucken
-Das könnte Sie auch interessieren
-@Drei Fragen an die Lagerleitung
-Impressum | Datenschutz | AGB
-Nach oben
-Wir verwenden Cookies. Alle akzeptieren | Ablehnen

-@Accueil
-@Produits
-@Contact
-Accueil > Produits
+Le moulin tourne à nouveau
+Le moulin a été réparé en six mois par deux charpentiers du village. Il moud désormais le blé de trois fermes et se visite le samedi.
-Partager cet article
-Articles liés
-@La farine et le pain
-Mentions légales
-Plan du site
-Haut de page
-Nous utilisons des cookies. Tout accepter | Tout refuser

-@Inicio
-@Productos
-@Contacto
+La panadería abre más temprano
+Desde marzo la panadería abre a las cinco y media para los conductores del primer autobús. El café se sirve en la barra y el pan sale del horno a las seis.
-Compartir
-Artículos relacionados
-@Cómo se hace la masa madre
-Aviso legal | Privacidad
-Volver arriba
-Usamos cookies. Aceptar | Rechazar

-@ホーム
-@製品
-@お問い合わせ
+港の時計が直りました
+港の時計は二十年ぶりに動き始めました。修理には三か月かかり、費用は町の人たちが出しました。
-この記事を共有する
-関連記事
-@灯台の歴史
-プライバシーポリシー
-ページの先頭へ
-当サイトはクッキーを使用しています。同意する 拒否する

-@Главная
-@Услуги
-@Контакты
+Мост открыли раньше срока
+Новый мост открыли на две недели раньше срока. По нему уже проехали первые автобусы, а пешеходы ходят бесплатно.
-Поделиться
-Похожие статьи
-@История моста
-Политика конфиденциальности
-Наверх
-Мы используем файлы cookie. Принять | Отклонить

-@Αρχική
-@Υπηρεσίες
-@Επικοινωνία
+Το πλοίο ξεκίνησε
+Το νέο πλοίο ξεκίνησε το πρώτο του ταξίδι το Σάββατο. Οι επιβάτες έφτασαν στο νησί σε δύο ώρες και γύρισαν το βράδυ.
-Κοινοποίηση
-Σχετικά άρθρα
-Όροι χρήσης
-Επιστροφή στην αρχή
-Χρησιμοποιούμε cookies. Αποδοχή | Απόρριψη

-@Blog
-@Support
+Page not found
+The page you asked for has moved or never existed.
-© 2020 Example Works
-Site map
"""
