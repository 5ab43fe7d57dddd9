"""Fixed values for problem 6: what template residue looks like.

Notices and filler are given as grammars of common wordings: `{a|b}` stands for one of its parts, which may hold others, `<n>` for a
number and `<id>` for a name made by a machine. The residue models are trained on sentences drawn from them; a field is judged by the
models' likelihood ratios, not by equality with a phrase.
"""

#: Words of the usual dummy text.
DUMMY_WORDS = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua "
    "enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in "
    "reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa "
    "qui officia deserunt mollit anim id est laborum leo justo vitae tellus risus lacus purus quam felis nibh orci urna porta "
    "augue ornare massa ante donec eget sapien tortor viverra mauris pellentesque habitant morbi tristique senectus netus malesuada"
).split()

_OBJECT = "{page|file|document|article|address|link|video|resource|content|URL|site|item}"
_WHERE = "{this|the|that|our|your}"
_SEE = "{view|see|use|open|load|read|access|display|watch}"
_SCRIPT = "{JavaScript|scripts|scripting|JavaScript support}"

#: Filler by family of wordings.
FILLER = {
    "goes here": ("{Text|Description|Summary|Transcript|Abstract|Title|Content|Overview|Caption|Heading|Body text|Introduction|Paragraph|Discussion|Your text|The text} {goes|comes|will go} here{.|}",),
    "insert here": ("{Insert|Add|Enter|Put|Type|Write|Paste} {your |a |the |some |}{text|description|summary|content|title|abstract|caption|overview} here{.|}",),
    "repeated word": ("{Text|Test|Sample|Dummy|Content|Words} {text|test} {text|test} {text|test}{ text| test|}{ text| test|}{.|}", "text text text text text text text.", "Text Text Text Text Text text."),
    "repeated marks": ("{xxxx|XXX} {xxxx|XXX} {xxxx|XXX} {xxxx|XXX}{ xxxx| XXX|}{ xxxx| XXX|}{ xxxx| XXX|}", "asdf asdf asdf asdf", "qwerty qwerty asdf asdf", "blah blah blah{ blah|}.", "foo bar baz foo bar baz"),
    "placeholder text": ("{This is {a |some |}|}{placeholder|sample|dummy|filler|example|test} {text|content|copy|description|paragraph}{.| only.| for now.}", "Replace {this|the} {text|sample|placeholder|description} with {your own|real text|real content|the final text}."),
    "to come": ("{Description|Text|Content|Details|Summary|Transcript|More|Documentation} {to come|to follow|to be added|to be written|to be determined|coming soon|will be added later|will follow}{.|}", "Coming soon{.|}", "To be {written|added|done|completed|announced|determined}."),
}

#: Error, sign-in, maintenance and access messages and notices that scripts are needed, by family of wordings.
NOTICES = {
    "status line": (
        "404{: | - | }{Not found|Page not found}{.|}", "{HTTP|Error} {404|500|503}{.|}",
        "{HTTP |Error |HTTP error |Status |}{404|410}{ - |: | }{Not found|Page not found|File not found|Gone|We could not find {that|this|the} " + _OBJECT + "}{.|}", "{HTTP |Error |Error code |}{404|410|500|502|503|504|403|401|429|400}{.|}",
        "{HTTP |Error |HTTP error |}{500|502|503|504|520}{ - |: | }{Internal Server Error|Bad Gateway|Service Unavailable|Gateway Timeout|Gateway Time-out|Server error}{.|}", "{HTTP |Error |}{403|401|429|400|405|451}{ - |: | }{Forbidden|Unauthorized|Too Many Requests|Bad Request|Access denied|Method not allowed}{.|}",
    ),
    "missing page": (
        "{Sorry, |Oops! |}" + _WHERE + " " + _OBJECT + " {you requested |you asked for |you are looking for |you’re looking for |you're looking for |you want |}{does not exist|doesn't exist|doesn’t exist|can’t be found|can't be found|cannot be found|could not be found|is missing|was not found|wasn't found|has been removed|has been deleted|has moved|no longer exists|never existed}{ or {has moved|was removed|was deleted|never existed|has been renamed}|}{ on this server|}.",
        "{We|You} {can't|can’t|cannot|could not|couldn't} {find|locate} " + _WHERE + " " + _OBJECT + "{ you requested| you asked for|}.", "{Page|File|Document|Article|Resource|Address|Video|Content} {not found|missing|does not exist|has moved}{.|}", "{There is|There's} nothing {here|at this address|to see here|at this location}.", "Nothing {found|to see|here|to show} {at|under} this {address|location|URL|link}.", "{Not found|Nothing found|Nothing here}.",
    ),
    "way out": (
        "{Please |}{check|verify} {the|your} {address|URL|spelling|link|connection}{ and {try|search} again|}.", "{Return|Go|Go back|Back|Click here to return|Take me} to the {overview|home page|homepage|start page|front page|main page|previous page|index|library}{.|}", "{Visit|See|Use|Try|Open} {the|our} {site map|sitemap|help page|search page|start page}{.|}", "{Search|Try|Load|Refresh|Reload} {again|the page|the site|this site|later}{.|}",
    ),
    "server failure": (
        "{The|Our} {server|service|system|site|application} {encountered|ran into|has met|reported|returned} {an internal|an unexpected|an unknown|an|a temporary} {error|problem}{ and could not complete your request|}.", "{Something|Something unexpected} went wrong{ on our end|}{.|!}", "An {unexpected|unknown|internal|application} error {occurred|has occurred|happened}{ while {processing|handling} your request|}.", "{Please |}{try|come back|check back} {again |}{later|soon|in a few minutes|in <n> seconds|in <n> minutes|after some time}.",
        "{Upstream|The upstream} {request|server|connection} {timed out|failed|has timed out}.", "{The|Your} {connection|request|operation} {has timed out|timed out|was reset|was closed|failed}.", "{This|The|Our} {service|server|site|page|video|video service|content} is {temporarily unavailable|currently unavailable|not available|unavailable|down|offline|temporarily unable to service your request}.", "{Service|Server|Site|Video|Content|Transcript|Page|Player} {temporarily |currently |}{unavailable|not available|could not be loaded|failed to load}.",
        "{Failed|Unable} to load {the |this |}{content|page|video|transcript|player|data|resource}.", "Loading{...|…| content...| page...}", "{This|The} " + _OBJECT + " is not available in your {region|country|area|location}.", "{The|This} {transcript|video|content|page|player} {could not|couldn't|can’t|can't|cannot} {be loaded|be played|be shown|load}.",
    ),
    "server name": ("{nginx|cloudflare|apache|varnish|envoy}{/<n>.<n>.<n>|}", "{cache|edge|proxy|node|server|gateway}-<id>", "{Reference|Reference number|Incident ID|Request ID|Trace ID|Ray ID|Error ID|Ticket}{ #|: }<id>", "{Server|Host|Served by}: {cache|edge|proxy|node}-<id>"),
    "access": (
        "Access {to this " + _OBJECT + " |}{is denied|denied|has been denied|was refused|is forbidden|is restricted}.", "You {don't|don’t|do not} have {permission|access|the rights|authorization|the right} to " + _SEE + " {this|the|that} " + _OBJECT + "{ on this server|}.", "{Your|The|This} {request|address|connection|account} {was|has been|is} {blocked|denied|rejected|refused}.", "{Request|Connection|Access} {blocked|denied|rejected|forbidden|refused}.", "You are not {allowed|authorized|permitted} to " + _SEE + " {this|the} " + _OBJECT + ".", "Forbidden.",
    ),
    "rate limit": ("Too many {requests|attempts|connections|downloads}{ from {your|this} {address|network}|}.", "{Rate|Request|Usage} limit {reached|exceeded|hit}.", "{Slow|Please slow} down{, please|}.", "{Your |The |Daily |}quota {exceeded|has been exceeded|is used up}.", "You have {reached|exceeded} {the|your} {limit|quota|rate limit|number of requests}."),
    "sign in": (
        "{Please |You need to |You must |You have to |}{sign in|log in|login} {again |first |}to {continue|" + _SEE + " {this|the} " + _OBJECT + "}.", "{Sign in|Log in|Login|Authentication} {required|is required|needed}.", "{Your|The} session {has expired|expired|has ended|timed out|is no longer valid}.", "You have been {signed out|logged out|signed off}.", "Session {expired|timed out|ended}.",
        "{Sign in|Log in} with your {account|password|user name|email address}{ to continue|}.", "{Only|This page is only for} {members|registered users|signed-in users|subscribers}{ can see this page|}.",
    ),
    "maintenance": (
        "{We’ll|We'll|We will} be {back|right back|online again} {soon|shortly|in a few minutes|in <n> minutes}.", "{Our|The|This} {site|library|service|server|video service|system|portal|player|archive} is {down|offline|closed|unavailable} for {maintenance|scheduled maintenance|planned maintenance|repairs|an upgrade}.", "{Scheduled|Planned} maintenance {in progress|is under way}.", "{Down|Closed|Offline} for {scheduled |planned |}maintenance.", "{The|Our|This} {site|service|page|library} is {undergoing|under} {scheduled |planned |}maintenance.",
        "{Please |}{come|check} back {later|soon|in an hour|tomorrow}.", "{We are|We're} {performing|carrying out|doing} {scheduled |planned |some |}maintenance.",
    ),
    "scripts needed": (
        "{This|The|Our} " + _OBJECT + " {requires|needs|will not work without|doesn't work without|depends on} " + _SCRIPT + "{ to work| to run|}.", "{Please |You need to |You must |You have to |}{turn on|enable|activate|allow|switch on} " + _SCRIPT + " {in your browser |}{to|and reload to|and refresh the page to} " + _SEE + " {this|the|its} " + _OBJECT + ".",
        "{Please |You need to |You must |}{turn|switch} " + _SCRIPT + " on {to|in your browser to} " + _SEE + " {this|the} " + _OBJECT + ".", _SCRIPT + " {is|are} {disabled|turned off|switched off|blocked|required|not enabled|needed}{ in your browser|}.", "Your browser {does not support|doesn't support|has disabled|blocks|is blocking} " + _SCRIPT + "{, so {the|this} {player|page|video} {can't|can’t|cannot} {load|be shown|play}|}.",
        "Your browser has " + _SCRIPT + " {turned off|switched off|disabled}{, so {the|this} {player|page|video|content} {can't|can’t|cannot} {load|be shown|play|be played}|}.", "{This|The} {video|page|player|content} {can't|can’t|cannot} be {played|shown|loaded|displayed} because " + _SCRIPT + " {is|are} {turned off|disabled|switched off}.", "Without " + _SCRIPT + " this " + _OBJECT + " can't be {shown|loaded|displayed}.",
    ),
    "other languages": (
        "{Seite|Datei|Inhalt} nicht gefunden{ (404)|}{.|}", "Bitte {aktivieren|erlauben} Sie JavaScript{, um {diese Seite|diesen Inhalt|das Video} {anzuzeigen|anzusehen|zu sehen}|}.", "{Bitte melden|Melden} Sie sich an, um {fortzufahren|diese Seite zu sehen}.", "Zugriff {verweigert|nicht erlaubt}.", "Diese Seite {benötigt|erfordert} JavaScript.", "{Der Dienst|Die Seite} ist {vorübergehend|derzeit} nicht {verfügbar|erreichbar}.",
        "{Page|Fichier|Contenu} {introuvable|non trouvée}{ (404)|}{.|}", "Veuillez activer JavaScript{ pour {afficher|voir} {cette page|ce contenu|la vidéo}|}.", "{Accès|L'accès est} refusé.", "{Veuillez vous connecter|Connectez-vous} pour {continuer|voir cette page}.", "Le service est temporairement indisponible.",
        "{Página|Archivo|Contenido} no {encontrada|encontrado|disponible}{ (404)|}{.|}", "{Active|Habilite|Por favor, active} JavaScript{ para {ver|mostrar} {esta página|este contenido|el vídeo}|}.", "Acceso {denegado|no permitido}.", "{Inicie|Inicia} sesión para continuar.", "El servicio no está disponible temporalmente.",
        "{Página|Arquivo|Conteúdo} não {encontrada|encontrado|disponível}{ (404)|}{.|}", "{Ative|Habilite|Por favor, ative} {o |}JavaScript{ para {ver|exibir} {esta página|este conteúdo|o vídeo}|}.", "Acesso {negado|não permitido}.", "{Entre|Faça login} para continuar.",
        "{Pagina|File|Contenuto} non {trovata|trovato|disponibile}{ (404)|}{.|}", "{Attiva|Abilita|Attivare} JavaScript{ per {vedere|visualizzare} {questa pagina|questo contenuto|il video}|}.", "Accesso {negato|non consentito}.", "Accedi per continuare.",
        "{Pagina|Bestand|Inhoud} niet {gevonden|beschikbaar}{ (404)|}{.|}", "{Schakel JavaScript in|Zet JavaScript aan}{ om {deze pagina|deze inhoud|de video} te {bekijken|zien}|}.", "Toegang {geweigerd|niet toegestaan}.", "Log in om {verder te gaan|deze pagina te zien}.",
        "{ページ|ファイル|コンテンツ}が見つかりません{。|}", "{この|}{ページ|コンテンツ|動画}を{表示|再生}するには{、|}{ |}JavaScript{ |}を有効にしてください。", "JavaScript{ |}を有効にしてください。", "アクセスが拒否されました。", "続けるにはサインインしてください。",
        "{找不到|未找到}{页面|文件|内容}{。|}", "{页面|文件}不存在{。|}", "{请|您需要}{启用|开启|打开}{ |}JavaScript{ |}{以|才能}{查看|显示}此{页面|内容|视频}{内容|}。", "要{查看|显示}此{页面|内容}，请{启用|开启} JavaScript。", "{拒绝访问|访问被拒绝}。", "请登录以{继续|查看此页面}。",
    ),
}

#: Ordinary sentences, which stand beside the texts at hand, as a small table has few.
PROSE = (
    "You can choose how often the values are written, and the default is once a minute.", "The first argument names the folder, and the second one tells how deep to look.", "When a list grows, the rows below it move down and keep their own height.",
    "We measured the time of each step and found that most of it was spent on sorting.", "If the answer takes longer than expected, the client waits and asks another server.", "An error in one part does not stop the others, and its message is kept for the report.",
    "The page shows a title, a short text and a link to the next part of the guide.", "People who use a keyboard can reach every control with the arrow keys.", "Write down what the reader needs to know first, and leave the details for later.",
    "This function returns the position of the first match, or nothing if there is none.", "The team looked at several ways to store the files and chose the simplest one.", "After the update the colours are brighter and the letters are easier to read.",
    "A session keeps its settings until the window is closed, and then they are written to disk.", "Each request carries a number, so that answers can be matched with questions.", "Not every browser draws the same shapes, so compare the results on several machines.",
    "The video explains how light travels through glass and why it bends.", "In the next chapter we build a small service that counts visitors.", "Permission is asked for once, and the choice can be changed in the settings.",
    "Thank you all for coming, and let's begin with a short look at the past year.", "So what does that mean for you? It means that you can write less code.", "The description of the format is in the appendix, along with three examples.",
    "Maintenance of old bridges costs more than most cities had planned.", "Please remember that the order of the steps matters.", "To see the difference, open both pictures and look at the upper left corner.",
)

#: Placeholders that a template engine, an editor or an author left unfilled. Each begins with a plain character, so that the search is fast.
PLACEHOLDERS = (
    r"\{\{[^{}\n`]{1,80}\}\}", r"\$\{[A-Za-z_][\w.]{0,60}\}", r"<%[=-]?[^%\n]{1,80}%>", r"%%[A-Za-z][A-Za-z_]{1,40}%%", r"__(?<!\w__)[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__(?![\w_])",
    r"%(?<![\w%]%)[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*%(?![\w%])", r"<#[^#\n]{1,80}#>", r"\[(?:TODO|TBD|TBC|INSERT|FIXME|PLACEHOLDER|XXX)\b[^\]\n]{0,80}\]", r"TODO(?<!\wTODO)(?:\([^)\n]{1,40}\))?:\s", r"FIXME(?<!\wFIXME)(?:\([^)\n]{1,40}\))?:\s",
    r"\[\[[A-Za-z_ ]{2,40}\]\]", r"\{%[^%\n]{1,80}%\}", r"<(?:INSERT|YOUR|ADD)[ _][A-Z_ ]{2,40}>", r"\$[A-Z][A-Z0-9]*_[A-Z0-9_]+\$", r"@@[A-Z][A-Z_]{1,40}@@",
)

#: Words that stand for no value, when a field holds nothing else.
EMPTY_VALUES = frozenset(
    ("null", "undefined", "none", "nil", "nan", "n/a", "na", "#n/a", "[object object]", "(null)", "<null>", "(none)", "(empty)", "empty", "void", "tbd", "tba", "todo", "missing", "unknown", "not available", "no value", "no data", "-", "--", "---", "n.a.", "?", "false", "\\n", "\"\"", "''", "{}", "[]", "()", "#ref!", "#value!")
)
