"""Trusted labels: lines that stand where content should be, and lines that only speak about such things.

One line each, as it would be typed. In them {{x}} stands for any unfilled placeholder, and numbers for any number.
"""

RESIDUE = """
{{x}}
{{x}} - {{x}}
{{x}} {{x}}
lorem ipsum dolor sit amet consectetur adipiscing elit
Title goes here
Heading goes here
Heading one
Heading 1
Sample headline - replace me
Headline goes here
Subtitle goes here
Add your description in the editor to the left.
Add your text here
Click here to add your own text
Insert text here
Your text here
Your content goes here
This is a sample page. Replace this text with your own.
This is dummy text.
This is placeholder text.
Placeholder text
Dummy text
Sample text
Sample page
COPY TO COME
Text to come
Content to follow
Content coming soon
TODO: text for this section is still missing
TODO
TBD
TBC
xxx xxx xxx
xxxx
test test test 1
test test test
test test
asdf asdf
foo bar baz
blah blah blah
Hello world! Welcome to your new site. This is your first post. Edit or delete it.
Welcome to undefined, your partner for null.
Object [object Object] could not be shown
[object Object]
Prices from NaN EUR per undefined
Dear None, thank you for your interest in None.
undefined
null
NaN
undefined undefined
null null
Nothing here yet.
No content yet.
Loading...
Loading, please wait...
Please wait...
Please wait while we load your content
Page not found
404 - Page not found
404 Not Found
404 error
Error 404
Not Found
The page you are looking for has moved or never existed.
The page you requested could not be found.
The page you are looking for does not exist.
The requested page could not be found.
The requested URL was not found on this server.
Sorry, this page isn't available.
Oops! We can't find that page.
Oops! Something went wrong.
Something went wrong. Please try again later.
Error 500: something broke on our side
500 Internal Server Error
Internal Server Error
502 Bad Gateway
503 Service Unavailable
504 Gateway Timeout
Service Unavailable
Service temporarily unavailable
The service is temporarily unavailable
HTTP 403 Forbidden
403 Forbidden
Forbidden
401 Unauthorized
Access denied
Access denied. Automated requests are blocked.
You don't have permission to access this resource.
The requested URL was rejected. Your support id is 123
Too many requests - slow down
429 Too Many Requests
Session expired. Reload to continue.
Your session has expired. Please log in again.
Database connection could not be established
Error establishing a database connection
Fatal error: call to a missing function in /srv/site/theme/index on line 212
Fatal error: Uncaught Error: Call to undefined function
Warning: cannot modify header information
Index of /public
Index of /
Directory listing for /
It works!
Welcome to nginx!
Default web site page
This domain is parked and may be for sale.
This domain is for sale.
This domain is parked free of charge.
Buy this domain.
The domain may be for sale.
This account has been suspended by the hosting provider.
This account has been suspended.
Account suspended
Website coming soon
Coming soon
Our new website is coming soon.
Site under construction
This site is under construction.
Under construction
We are down for planned maintenance and will be back soon.
We are currently down for maintenance.
Site is undergoing maintenance
Down for maintenance
You need to enable JavaScript to run this app.
Please switch on JavaScript to use this site.
Please enable JavaScript to continue.
Please enable JavaScript in your browser.
JavaScript is required to view this page.
JavaScript is disabled in your browser.
This site requires JavaScript.
This page requires scripts. Your browser has them turned off.
Your browser does not support scripts.
Your browser is not supported. Please update it.
Your browser is out of date. Please update your browser.
Enable cookies and scripts, then try again.
Please enable cookies to continue.
Cookies are disabled in your browser.
Verify you are not a robot to continue
Please verify you are a human
Are you a robot?
I am not a robot
Checking your browser before accessing the site.
Checking if the site connection is secure
Please complete the security check to access this site.
Überschrift hier eingeben
Text hier eingeben
Text folgt in Kürze.
Text folgt
Inhalt folgt in Kürze.
Hier steht Ihr Text.
Blindtext
Platzhaltertext
Hier entsteht eine neue Internetpräsenz.
Diese Domain steht zum Verkauf.
Diese Domain ist geparkt.
Seite nicht gefunden
Die angeforderte Seite existiert leider nicht (mehr).
Die angeforderte Seite wurde nicht gefunden.
Die gewünschte Seite konnte nicht gefunden werden.
Fehler 503 - Dienst nicht verfügbar
Dienst nicht verfügbar
Interner Serverfehler
Zugriff verweigert
Wartungsarbeiten: Wir sind bald wieder da.
Wegen Wartungsarbeiten nicht erreichbar
Diese Seite befindet sich im Aufbau.
Bitte aktivieren Sie JavaScript in Ihrem Browser.
Bitte aktivieren Sie JavaScript.
Diese Anwendung benötigt JavaScript.
Bitte aktivieren Sie Cookies.
Ihr Browser wird nicht unterstützt.
Einen Moment, Ihr Browser wird geprüft.
Bitte bestätigen Sie, dass Sie kein Roboter sind.
Texte à venir
Contenu à venir
Texte à remplacer
Saisissez votre texte ici
Titre à saisir
Faux texte
Page introuvable
Erreur 404
La page demandée est introuvable.
La page que vous cherchez n'existe pas.
Erreur interne du serveur
Service indisponible
Service temporairement indisponible
Accès refusé
Site en cours de maintenance
Site en construction
Site en maintenance
Ce domaine est à vendre.
Veuillez activer JavaScript pour afficher cette page.
Veuillez activer JavaScript.
Veuillez activer les cookies.
Votre navigateur n'est pas pris en charge.
Vérification de votre navigateur en cours
Confirmez que vous n'êtes pas un robot
Texto pendiente de redactar
Texto de ejemplo
Texto de relleno
Escriba su texto aquí
Título aquí
Contenido próximamente
Próximamente
Página no encontrada
Error 404: página no encontrada
La página que busca no existe.
Error interno del servidor
Servicio no disponible
Acceso denegado
Sitio en construcción
Sitio en mantenimiento
Este dominio está en venta.
Active JavaScript para ver esta página.
Habilite JavaScript en su navegador.
Su navegador no permite scripts.
Su navegador no es compatible.
Comprobando su navegador
Active las cookies para continuar.
Confirme que no es un robot
ここに文章が入ります。
ここに見出しが入ります。
ここにテキストを入力してください。
ダミーテキスト
サンプルテキスト
準備中です。
ただいま準備中です。
工事中
ページが見つかりません
お探しのページは見つかりませんでした。
ただいまメンテナンス中です。
メンテナンス中
内部サーバーエラー
アクセスが拒否されました
このページを表示するにはJavaScriptを有効にしてください。
JavaScriptを有効にしてください。
Cookieを有効にしてください。
お使いのブラウザはサポートされていません。
ブラウザを確認しています
ロボットではないことを確認してください
Страница не найдена
Запрашиваемая страница не существует.
Ошибка 404
Внутренняя ошибка сервера
Сервис недоступен
Сайт временно недоступен
Сайт в разработке
Сайт находится в разработке
Технические работы
Доступ запрещён
Домен продаётся
Здесь будет текст
Текст скоро появится
Введите текст
Включите JavaScript в браузере.
Пожалуйста, включите JavaScript.
Включите файлы cookie.
Ваш браузер не поддерживается.
Проверка браузера
Подтвердите, что вы не робот
Η σελίδα δεν βρέθηκε
Σφάλμα 404
Εσωτερικό σφάλμα διακομιστή
Η υπηρεσία δεν είναι διαθέσιμη
Ο ιστότοπος είναι υπό κατασκευή
Υπό κατασκευή
Εργασίες συντήρησης
Ενεργοποιήστε τη JavaScript.
Ενεργοποιήστε τα cookies.
Το πρόγραμμα περιήγησης δεν υποστηρίζεται.
Το κείμενο θα προστεθεί σύντομα
Κείμενο εδώ
"""

TALK = """
In a template you write {{x}} and the system puts in the guest's name before the message is sent.
Write {{x}} in the template and the name of the customer is put in before sending.
Our designers never start from lorem ipsum: each draft is made with real room names and real prices.
The monitor raises an alarm when a partner feed answers with 404 Not Found or 502 Bad Gateway for more than 90 minutes.
The widget needs JavaScript; visitors without it see a plain form instead, which 3 percent of guests prefer.
Error 404 was the most frequent ticket in 2019; after the move it fell to 20 cases.
During the maintenance window last spring 20 sites stayed online, because the system kept a local copy.
Ohne JavaScript zeigt das Formular eine einfache Fassung, die 9 Betriebe bewusst nutzen.
Meldet ein Partner Fehler 502, so springt nach 5 Minuten die Reserveleitung ein.
"""
