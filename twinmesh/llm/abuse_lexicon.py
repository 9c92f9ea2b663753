"""Word classes and rules of the content grammar (English, German, French, Spanish): fixed values, in plain text.

Words are written folded: lower case, without diacritics, ss for sharp s; ``idiot(s,in)`` stands for the stem and
the stem with each ending. A word may be in several classes. Classes in DISGUISED are also recognised when
masked, spaced out, respelled or misspelled. None of the rules names a sentence: they combine who is meant, what
is said of them or done to them, and open slots (_).
"""

from __future__ import annotations

CLASSES: dict[str, str] = {
    # who
    "YOU": "you u ya ye du dich dir euch ihr tu te toi t vous usted ustedes vosotros os ti",
    "YOUR": "your ur yours dein(e,en,er,em,es) eure(n,r,m) ton ta tes votre vos tu tus su sus vuestro vuestra",
    "YOURSELF": "yourself yourselves dich toi te vous",
    "ARE": "are r re bist seid es etes eres sois",
    "YOUARE": "youre ure eres bist",
    "I": "i im ill id ive me we us ich wir mich mir uns je j moi nous on yo mi nos nosotros me m",
    "MY": "my our mein(e,en,er,em) unser(e,en) mon ma mes notre nos mi mis nuestro nuestra",
    "THEY": "he she they him them it hes shes theyre er sie es ihn ihnen il elle ils elles lui eux leur ce c el ella ellos ellas",
    "THEIR": "his her their ihr(e,en) sein(e,en) son sa ses leur leurs su sus",
    "WHO": "somebody someone anybody anyone everybody everyone whoever who whos jemand wer jeder man quelqu un quiconque qui on alguien quien quienes cualquiera",
    "NOBODY": "nobody noone none niemand keiner keine personne nadie",
    "KIN": "mother mom mum mama father dad family dog parents parent wife husband girlfriend boyfriend sister brother kids kid children child son daughter mutter vater familie hund eltern frau mann kinder mere pere famille chien parents femme enfants madre padre familia perro padres mujer hijos hijo hija",
    "PERSON": "guy man woman boy girl dude bloke boss manager colleague neighbour neighbor teacher admin moderator uploader author user chef kerl typ mann frau nachbar lehrer type mec gars voisin prof patron tio tipo hombre vecino jefe profesor",
    "BE": "am are is be being been was were re s bin bist ist sind sei seid war waren sein werden suis es est sont etes etre etait soy eres es son estan esta esto estoy ser era eran estas",
    "DET": "a an the ein eine einen einem einer der die das den dem un une le la les l des de du d el los las una unos unas this that these those diese(r,n,s) dieses ces cette cet ese esa este esta esos esas such so qu que",
    "ADV": "just only nothing but all always really so such very too quite simply truly literally still also total(ly) complete(ly) absolute(ly) utter(ly) pure actual(ly) real big bigger biggest most more such nur alle alles nichts als immer echt wirklich so sehr total einfach doch so komplett absolut richtig gross(e,er,es) rien que tous toutes tout toujours vraiment tellement si trop simplement juste totalement solo todos todas siempre realmente tan muy demasiado simplemente puro pura vaya rather plain right proper fairly a an one of the",
    "MODAL": "should must ought could can shall have has need needs to had soll(en,te,ten) muss mussen musste(n) kann konnen darf gehort gehoren faut faudrait doit doivent devrait devraient devez il hay que habria deberia(n) deben debe tiene tienen",
    "WILL": "will gonna going ll would want wants wanna shall swear promise about werde(n) wird will wollen vais va vas allons allez vont voy vamos van quiero veux",
    "AND": "and und et y e or oder ou o",
    "CONJ": "and but because so then und aber denn weil sondern et mais car donc y pero porque sino",
    "NEG": "not no never nor isnt arent dont doesnt didnt wont wouldnt cannot cant couldnt shouldnt wasnt werent aint havent without nobody nicht kein keine keiner keinen nie niemals niemand ohne pas jamais personne ne n aucun sans ni nunca nadie sin jamas",
    "WHY": "why warum wieso pourquoi",
    "UNNEG": "believe wait stand stop only just merely help",
    "IF": "if when wenn si cuando quand",
    # insults
    "INSULT": "miserable(s) moron(s,en,ic) idiot(s,en,in,e,es) imbecile(s) imbecil(es) cretin(s,e,es,o) halfwit(s) dimwit(s) nitwit(s) dumbass(es) jackass asshole(s) arsehole(s) bastard(s) bitch(es) scumbag(s) loser(s) jerk(s) dickhead(s) prick(s) twat(s) wanker(s) tosser(s) bellend(s) slut(s) whore(s) skank hoe retard(s) dunce(s) douche douchebag(s) shithead(s) motherfucker(s) fuckwit(s) fucker(s) cunt(s) lowlife(s) sleazebag pervert(s) creep(s) dipshit(s) simpleton(s) ignoramus bimbo imbeciles incel cuck schmuck numbskull numpty blockhead pinhead airhead ingrate wretch"
    " trottel vollidiot(en) schwachkopf schwachkopfe arschloch arschlocher mistkerl(e) penner versager(in) wichser hurensohn hurensohne dummkopf depp(en) volltrottel schlampe(n) drecksau hure(n) dreckskerl vollpfosten blodmann dumpfbacke spast(i,en) missgeburt(en) arsch nichtsnutz taugenichts drecksack schweinehund fotze(n) nutte(n) opfer lappen"
    " connard(s) connasse(s) conne(s) con(s) debile(s) abruti(s,e,es) ordure(s) minable(s) salaud(s) salope(s) salopard(s) batard(s,e,es) encule(s,e) pute(s) putain bouffon(s,ne) tocard(s) enfoire(s,e) crevard(s) raclure couillon(s) cretine(s) petasse(s) trouduc raté"
    " idiota(s) imbecil(es) cretino(s,a,as) cretina gilipollas cabron(es,a) inutil(es) estupido(s) estupida(s) tonto(s) tonta(s) pendejo(s,a) hijoputa(s) puta(s) puto(s) capullo(s) subnormal(es) zorra(s) mamon(es) payaso(s) memo bobo(s) idiotas maricon(es) malparido(s,a) mierdas fracasado(s) fracasada desgraciado(s) desgraciada",
    # insults of a person only where a person is meant
    "SOFT": "pig(s) swine cow dog rat(s) snake weasel parasite(s) clown(s) joke fool(s) coward(s) liar(s) disgrace failure trash garbage scum filth vermin waste burden monkey ape donkey ass arse sheep maggot(s) worm(s) cockroach leech(es) disease cancer mess embarrassment hack witch hag monster freak(s) psycho lunatic toad troll weirdo ghoul dirt turd crap shit cock dick pussy tool muppet plank melon lemon doughnut"
    " schwein(e) sau esel affe kuh ziege hund ratte(n) parasit(en) abschaum dreck mull witz clown feigling lugner schande ungeziefer wurm wicht"
    " porc cochon(ne) chien(ne) vache ane rat(s) singe parasite(s) dechet(s) merde lache menteur honte nul(le) vermine clown larve"
    " cerdo(s,a) perro perra burro vaca rata(s) mono parasito(s) basura escoria mierda cobarde mentiroso mentirosa verguenza bestia gusano(s) miserable(s) asco",
    "ADJ": "talentless boring fat skinny bald ignorant arrogant greedy cowardly lying nasty hideous evil gormless witless two-faced ignorante(s) feig(e,er) stupid(er,est) filthy(er) pathetic spineless brainless worthless useless disgusting dumb(er,est) blind ugly(er) ugliest miserable braindead gutless clueless moronic idiotic imbecilic retarded repulsive vile revolting fat rotten inbred deranged incompetent hopeless despicable contemptible slimy smelly toothless heartless shameless"
    " dumm(e,er,es,en) dumme(r,s) blod(e,er,es,en) erbarmlich(e,er,es,en) dreckig(e,er,es,en) nutzlos(e,er,es,en) wertlos(e,er,es,en) hirnlos(e,er,es,en) hasslich(e,er,es,en) ekelhaft(e,er,es) fett(e,er,es) bescheuert(e,er,es) behindert(e,er,es) hohl(e,er) unfahig(e,er) widerlich(e,er,es)"
    " bete(s) stupide(s) minable(s) pauvre sale(s) gros grosse ignoble moche(s) laid(e) debile(s) nul(le) inutile(s) degoutant(e) pathetique(s) lache"
    " estupido(s,a,as) tonto(s,a,as) pobre asqueroso(s,a,as) maldito(s,a,as) feo(s,a) inutil(es) patetico(s,a) despreciable(s) repugnante(s) gordo(s,a)",
    "ADJMILD": "lazy little old silly sad cheap small cruel mean crazy mad sick annoying rude faul(e,er) klein(e,er) krank(e,er) petit(e) vieux vieille fou folle pequeno pequena viejo vieja loco loca",
    "SWEAR": "putos putas jodidos malditos malditas sales fuck(s,ed) fucking fuckin fkn bullshit shit(s,ty) crap damn(ed) goddamn bloody freaking effing merde(s,ique) putain putains scheisse scheiss verdammt(e,er) verfickt(e,er) beschissen(e,er) drecks mierda(s) cono joder jodido(s,a) jodida puto puta pinche maldito maldita foutu(e,s) puteain bollocks",
    "PIECE": "piece sack pile bag load lump bunch stuck haufen sack tas morceau gros pedazo trozo saco monton espece especie cara bande pack",
    "CRAPNOUN": "shit crap garbage trash dirt scum filth turd scheisse mist dreck mull merde(s) ordure dechet mierda basura",
    "SHUTUP": "fresse klappe schnauze maul gueule bocazas",
    "SHUT": "shut stfu halt haltet ferme fermez ta cierra callate callaos calla",
    "DISMISS": "gtfo verpiss verpisst verzieh casse degage degagez tire barre largate lárgate callate calla lárguense vete piérdete pierdete",
    "SCREW": "fuck screw fick fickt nique niquez baise leck jodete jodanse chingate chinga foutre",
    "OFFWORD": "off yourself dich euch toi vous tes ta you u mere race mich",
    "GET": "get go piss fuck bugger sod crawl va geh vete allez fous scher",
    "LOST": "lost hell off fuck teufel holle foutre diable mierda infierno diablo away rock hole",
    "BRAINS": "brains brain wits sense iq intelligence guts spine skills hirn verstand grips cerveau cervelle cerebro seso sesos luces",
    "HAS": "have has had got hat habe hast haben a as ont ai tiene tienes tienen tengo",
    "MORE": "more less mehr weniger plus moins mas menos",
    "THAN": "than als que",
    "SMELL": "smell smells stink stinks stinkst stinkt riechst pues puez apestas apesta hueles",
    "LOOK": "look looks talk talks sound sounds act acts think write writes type behave redest laberst siehst schreibst parles ecris hablas escribes pareces",
    "LIKE": "like wie comme como",
    "LOUSY": "broken rotten wet dead dying cheap drunk sick empty cracked lame blocked kaputt casse rota roto",
    "FACE": "face voice presence existence breath work mug gesicht stimme gueule tete cara voz",
    "RUIN": "ruins ruin ruining spoils sickens disgusts annoys hurts verdirbt gache arruina",
    "AVOID": "avoids avoid hates hate despises despise laughs laugh laughing ignores pities hasst hassen lacht deteste detestent odia odian rie rien likes like loves love wants want mag",
    "ASHAMED": "ashamed embarrassed disgusted schamen schamt honte verguenza averguenza avergonzado avergonzada",
    "EXIST": "exist existence born breathe existierst geboren existes exister nacido existas existir",
    "WASTE": "waste verschwendung gachis desperdicio",
    "AIR": "air space oxygen skin sperm luft platz oxygene espace aire espacio oxigeno",
    "WHAT": "what welch quel quelle vaya menudo menuda que was so",
    "MUSTBE": "it must takes only nur solo seul seule il faut hay que muss",
    "UPON": "upload(s,ed) loads wrote write writes filed file files did does made makes think thinks say name would could tut ladt schreibt macht glaubt range ranger ecrit fait croit guarda guardar hace escribe cree hoch",
    # threats and wishes of harm
    "HURT": "smash kill stab shoot strangle beat choke crush slap punch hang drown bleed hurt burn destroy murder slaughter gut skin slit bash bury torture rape maim cripple poison hunt kills"
    " breche brechen brech schlage schlagen schlag totschlagen tote toten umbringen abstechen steche stechen erschiessen verprugeln prugeln vergewaltigen aufschlitzen erwurgen wurgen kaltmachen fertigmachen umlegen verbrennen zerstoren ersaufen"
    " casser casse tuer tue frapper frappe egorger etrangler buter bute crever creve rompre detruire defoncer defonce massacrer bruler noyer pendre fracasser saigner exploser violer demolir peter"
    " romper rompere matar mato matare golpear partir parto reventar ahogar quemar rajar degollar apunalar destrozar pegar violar hundir aplastar cortar arrancar matarte romperte partirte reventarte golpearte quemarte pegarte rajarte destrozarte",
    "HANDLE": "break cut rip tear snap shove push lock run feed knock kick throw end finish put drop drag tie set stick hit chop brechen schubsen stossen werfen sperren einsperren pousser jeter enfermer balancer empujar tirar encerrar lanzar echar",
    "PLACE": "stairs staircase basement cellar bus train tracks river window wall ground fire trunk grave head treppe keller fenster fluss escalier cave fenetre escalera escaleras sotano ventana",
    "HURTYOU": "matarte romperte partirte reventarte golpearte quemarte pegarte rajarte destrozarte mataros",
    "BODY": "fingers finger hands hand jaw teeth tooth neck legs leg arms arm skull face head throat bones bone nose knees kneecaps spine ribs eyes eye balls guts knochen hals zahne kopf beine bein hande hand gesicht genick nase rippen finger kehle schadel doigts mains main dents cou jambes jambe os gorge tete gueule nez bras dedos manos mano dientes cuello piernas pierna huesos cabeza cara garganta boca nariz brazos",
    "KILLSELF": "kill hang shoot drown off bring hange erschiess suicide pends tue mate matate suicidate ahorcate cuelgate tirate",
    "DIE": "die dies died rot croak perish drop sterben stirb stirbst verreck verrecke verreckst krepier krepiert krepierst creve crever creves meurs mourir mourrez muere muerete muerase mueras morir morirte palmala burn hell",
    "GO": "go please just should geh solltest va vas allez vete ve please do",
    "KNOW": "know knows knew seen found followed saw weiss wissen habe kenne sais savons connais trouve se sabemos conozco se visto",
    "WHERE": "where wo ou donde which way what",
    "LIVE": "live lives park parks sleep sleeps work works sit sits home house desk car street address kids school yours wohnt lebt vive vit wohnst parkst sitzt schlafst arbeitest wohnt adresse habites dors gares travailles vis adresse ecole vives duermes aparcas trabajas casa colegio direccion",
    "BEWARE": "back careful sleep eye pray hide run lieber vorsichtig mefie attention gare cuidate cuidado reza prepare",
    "WATCH": "watch pass dreh schlaf fais surveille mefie vigila mira cuida cuidate better sleep hide",
    "REGRET": "regret pay suffer cry bleed beg bereuen bussen zahlen leiden bluten regretter payer souffrir saigner pleurer arrepentiras pagaras pagar sufrir llorar arrepentir",
    "DEADMAN": "dead toast finished numbered over tot erledigt mort morte fini muerto muerta",
    "HOPE": "hope wish want pray hoffe hoffentlich wunsche espere souhaite espero ojala deseo",
    "HARM": "falls fall burns burn lose loses die dies rot rots choke crash crashes suffer suffers bleed cancer drown stirbst sterbt verreckst verreckt verbrennst krepierst brennt krebs leidest creves creve meurs meures brule cancer perdes souffres mueras muere pierdas sufras ardas queme cancer revientes",
    "HEAVY": "heavy cancer aids crash disease truck bus lorry krebs lkw maladie camion enfermedad camion",
    "HAVES": "home house teeth job everything life legs eyes sight family haus zahne arbeit leben alles maison dents travail vie casa dientes trabajo vida todo",
    "DESERVE": "deserve deserves deserved verdienst verdient verdienen merites merite meritent mereces merece merecen",
    "FAVOUR": "favour favor gefallen freude nett plaisir service alegria",
    "DISAPPEAR": "disappear vanish jump wake sea cliff bridge dock leave quit die away verschwinde verschwinden spring stirb wach disparais disparaitre saute reveille reveilles creve meurs pars desaparece salta despiertes despertar muerete tirate roof dach toit tejado puente brucke pont",
    "MISS": "miss misses missed vermisst vermissen pleurera pleurer manquera manqueras regrettera extranar extranara llorara echara",
    "BETTEROFF": "better besser mieux mejor cleaner happier nicer safer glucklicher",
    "WITHOUT": "without ohne sans sin",
    # groups and attacks on them
    "GROUP": "immigrant(s) migrant(s) refugee(s) foreigner(s) women females muslim(s) islamist(s) jew(s) jewish gay(s) homosexual(s) lesbian(s) trans transsexuals queers black(s) blacks gypsy gypsies gypsie(s) arab(s) african(s) asian(s) mexican(s) latino(s) indian(s) pakistani(s) chinese turk(s) pole(s) poles romani roma disabled cripple(s) christian(s) catholic(s) hindu(s) atheists nigerians syrians afghans natives aboriginals homeless negroes"
    " fluchtling(e,en) auslander(n,in,innen) migranten asylanten asylbewerber muslime(n) moslem(s) juden jude schwule(n) lesben zigeuner(n) turken araber(n) neger schwarze(n) afrikaner frauen weiber behinderte(n) alte(n) polen russen christen obdachlose(n)"
    " etranger(s) refugie(s) immigre(s) migrants femmes vieux juif(s) musulman(s) arabe(s) noir(s) handicape(s) gitan(s) homosexuels africain(s) roms asiatiques chretiens clandestins"
    " extranjero(s) extranjera(s) refugiado(s) inmigrante(s) migrante(s) mujeres viejo(s) judio(s) musulman(es) moro(s) negro(s) gitano(s) homosexuales discapacitado(s) africano(s) arabes rumanos chinos indigenas cristianos",
    "SLUR": "nigger(s) nigga(s) faggot(s) fag(s) kike(s) spic(s) chink(s) gook(s) paki(s) tranny trannies wetback(s) towelhead(s) raghead(s) dyke(s) coon(s) kanake(n) kanacke(n) schwuchtel(n) kummelturke(n) bougnoule(s) bicot(s) negre(s) youpin(s) tapette(s) pede(s) tarlouze sudaca(s) maricon(es) marica(s) bollera(s) panchito(s) moraco(s)",
    "FOLK": "people folk folks tribe tribes believers residents leute volk stamm stamme glaubigen menschen gens peuple croyants gente creyentes pueblo pescadores bergleute personas",
    "THEM": "them em sie die les los las all alle tous todos",
    "TRIBE": "folk folks tribe tribes believers volk stamm stamme",
    "GROUPADJ": "old black white brown disabled trans poor homeless foreign jewish muslim gay asian african arab native deaf fat coloured colored such these those",
    "OFGROUP": "faith religion race colour color skin descent origin blood kind glaubens glauben herkunft hautfarbe rasse foi couleur fleuve origine fe raza piel rio origen color",
    "VERMIN": "rats rat vermin parasite(s) cockroach(es) roaches animal(s) subhuman(s) filth plague scum trash garbage pest(s) pestilence savage(s) barbarian(s) virus disease cancer leeches locusts monkeys apes pigs dogs beasts insects bugs swine infestation invaders dirt scourge"
    " ratten ungeziefer parasiten plage abschaum tiere dreck pest untermenschen ratte schmarotzer affen schweine hunde krankheit seuche mull gesindel pack barbaren"
    " vermine racaille(s) peste parasites cafards animaux singes porcs chiens ordures maladie sous-hommes dechets barbares nuisibles"
    " ratas alimanas basura plaga parasitos cucarachas escoria animales monos cerdos perros enfermedad peste salvajes barbaros bestias",
    "CRIMINAL": "criminal(s) thief thieves rapist(s) terrorist(s) murderer(s) liars cheats scammers freeloaders invaders pedophiles predators killers parasites verbrecher kriminelle vergewaltiger diebe terroristen morder lugner betruger criminels voleurs violeurs terroristes menteurs assassins profiteurs criminales ladrones violadores terroristas mentirosos asesinos delincuentes",
    "INFERIOR": "inferior lower lesser subhuman primitive backward degenerate degenerates uncivilised uncivilized minderwertig minderwertige primitiv inferieurs inferieures primitifs inferiores primitivos",
    "LOWERKIND": "kind race breed species nature blood genes menschen rasse art race espece raza especie sangre",
    "EXPEL": "deport deported expel expelled ban banned remove lock locked cage caged kick throw ship send sent kept keep stop stopped sterilise sterilised sterilize sterilized castrate castrated abschieben abgeschoben ausweisen rauswerfen rausschmeissen wegsperren einsperren wegschaffen expulser virer chasser enfermer deporter renvoyer expulsar echar echarlos deportar encerrar largar",
    "EXTERMINATE": "exterminate exterminated wipe eradicate eradicated annihilate annihilated gas gassed slaughter massacre kill killed shoot shot hang hanged burn burned burnt drown nuke lynch lynched genocide purge cleanse cleansed erschiessen erschossen ausrotten ausgerottet vergasen vergast vernichten vernichtet toten verbrennen aufhangen totschlagen exterminer exterminez eliminer tuer gazer bruler massacrer pendre exterminar eliminar aniquilar matar quemar gasear fusilar colgar mueran muerte tod mort death",
    "OUT": "out back raus weg dehors fuera fort heim",
    "BURN": "burn sink smash torch bomb destroy blow raze set break attack anzunden abfackeln niederbrennen einschlagen bruler incendier casser saccager quemar incendiar romper",
    "PROPERTY": "houses house boats windows homes home shops shop church mosque mosques synagogue synagogues camps temple shelters hauser fenster moschee laden heime maisons mosquee magasins casas mezquita tiendas",
    "BEFORE": "before until fruher bevor ehe dann bis avant antes vorher dann",
    "BETTER": "better cleaner safer nicer quieter calmer peaceful decent fine great sauber(er) schon gut besser ruhig(er) sicher(er) mieux propre calme bien tranquille mejor limpio tranquilo seguro bonito",
    "CAME": "came come let got crawling moved arrived arrive invaded kamen kam liess liessen losgelassen zogen arrivent viennent laisse laisser laissait laissent entrer venir travailler arriver dejar dejaran llegaran llegar vinieran entrar",
    "EQUAL": "rights equal live vote breathe place allowed citizens belong respect trust breed leben rechte platz atmen wahlen vivre droits place vivir derechos sitio lugar",
    "BREED": "klauen klaut stinken roban breed steal steals lie lies rape rapes cheat stink smell infest multiply rob stealing stehlen lugen stinken vergewaltigen vermehren volent mentent violent puent roban mienten violan apestan",
    "REFUSE": "work works live share deal talk arbeite arbeiten wohnen travailler travaille vivre trabajo trabajar vivir trato",
    "WITH": "with near beside next mit neben avec con junto among",
    "HIRE": "hire serve trust employ feed help believe respect traue trauen einstellen embaucher servir confiance contratar servir confiar fies",
    "HATE": "hate hates despise loathe detest hasse hassen hasst deteste detestons hais odio odiamos",
    "KITCHEN": "kitchen camps camp prison jail zoo cage jungle gutter oven ovens kuche lager knast ofen gosse cuisine camp prison four cocina carcel horno jungla",
    "BELONG": "belong belongs gehort gehoren appartiennent pertenecen place",
    "COUNTRY": "country countries land heimat home pays pais africa afrika afrique mexico desert",
    "DOWNWITH": "nieder down abajo mort muerte tod death",
    # sexual
    "PORN": "porn porno pornos pornovideos pornography pornographic xxx hardcore blowjob(s) handjob(s) gangbang(s) creampie cumshot(s) deepthroat sexcam(s) camgirl(s) camgirls hentai bukkake milf(s) milf sextape(s) nudes dickpic(s) nacktbilder nacktfotos pornofilme sexvideos sexting onlyfans",
    "SEX": "sex sexe sexo sexual sexy erotic erotik erotique sexchat threesome orgy orgasm anal oral fetish",
    "NAKED": "naked nude nudes nackt(e,en,er) nue(s) nu desnuda(s) desnudo(s) topless undressed poil bare braless encueros",
    "GIRLS": "girls girl teens chicks babes ladies women boys wives madchen weiber frauen filles fille femmes chicas nenas mujeres tias",
    "MEDIA": "cam cams clip clips video videos photo photos foto fotos pic pics picture pictures series movie movies film films link links lien enlace bilder webcam stream chat selfie(s) selfies gallery channel tape filme show shows images imagenes videochat",
    "HOT": "hot heisse heissen heiss heisser chaud chaude(s) chauds caliente(s) full free uncut wild kinky dirty horny naughty steamy gratis gratuit(es) gratuit kostenlos geile geiler geilen live amateur",
    "HORNY": "horny geil cachondo cachonda excite excitee bande aroused randy wet hard turned",
    "FUCK": "fuck fucked fucking shag bang screw fick ficken fickt fickst gefickt bumsen vogeln baiser baise niquer sauter follar follarte follarme folla follo coger cogerte chingar poppen",
    "SUCK": "suck sucking lick licking ride riding stroke stroking swallow swallowing deepthroat jerk kiss bite spank rub grab squeeze touch touching taste lutsch lutschen blas blasen leck lecken reiten wichs suce sucer leche lecher branler branle chupa chupar chupame lamer lame pajear",
    "LICKYOU": "chuparte lamerte follarte cogerte comerte montarte tirarte",
    "LICK": "lick licking suck sucking ride lecken lutschen blasen reiten lecher sucer chevaucher lamer chupar montar",
    "CUM": "cum cums cumming climax squirt ejaculate orgasm abspritzen spritzen spritz kommen jouir ejaculer correrte correrme corrida",
    "TITS": "tits titties boobs boobies pussy cock cocks dick dicks cunt clit nipples ass arse butt balls titten schwanz muschi fotze mose brustwarzen arsch eier nichons bite chatte seins queue couilles cul fesses teton tetas polla cono culo verga pezones coño",
    "BREAST": "tits titties boobs titten nichons tetas",
    "STARE": "stare staring looking look watching thinking dreaming ogling fantasise fantasize starre schaue starren regarde regarder mate mater mirar mirando miro",
    "SEXADJ": "big huge hard wet tight juicy throbbing hot sexy dripping naked nice dicke geile feuchte harte prall gros grosse dure mouillee bandante gran grande dura mojada rica",
    "SENDME": "send sell share trade show give post schick schicke zeig zeige envoie envoyez montre montrez mandame mandame manda enviame ensename muestrame pasame",
    "UNDRESS": "undress strip unbutton ausziehen entkleiden deshabille deshabiller desnudate desnudarte desvistete desvestirte",
    "TAKE": "take open tear rip spread pull lift drop off zieh runter auf enleve enlever ote ouvre ecarte quitate quitarte abre levanta baja",
    "CLOTHES": "clothes blouse shirt skirt dress pants bra panties jeans trousers knickers legs thighs kleider bluse hemd rock hose bh hoschen beine aus vetements chemise jupe robe culotte jambes ropa blusa camisa falda vestido bragas piernas",
    "POSE": "bend sit kneel lie lay leg setz knie bück buck beug assieds penche allonge couche sientate arrodillate agachate tumbate",
    "ONME": "over lap knees top bed face mich mir schoss knien bett genoux lit moi rodillas cama regazo encima under",
    "TOUCH": "feel taste lick touch kiss caress stroke bite undress ride ravish devour pin fuhlen schmecken kussen streicheln anfassen toucher embrasser gouter caresser sentir tocar besar lamer saborear acariciar tocarte besarte",
    "SENSUAL": "scream moan moans tongue hips lap bed lips thighs naked breathless sweetheart baby honey top body skin night clothes inch against schreist stohnst stohnen haut zunge bett korper nacht crier gemir langue hanches lit peau corps nuit gritar grita gimas gemir lengua caderas cama piel cuerpo noche lentement langsam despacio slowly",
    "MOAN": "moaning groaning moan moans moaning begs groans gasps screams stohnt gemit gime",
    "COUPLE": "couple two her him she he guard them pair paar elle lui pareja ella",
    "DOINGIT": "doing going treiben faisant haciendo humping shagging screwing getting",
    "IT": "it at on es ca lo off",
    "SCENE": "uncut unzensiert explicit detail visible shower bed clothes bare floor nothing everything night ungeschnitten douche dusche ducha",
    "SHOWS": "clip video film tape scene shows show showing watch zeigt montre muestra",
    "WANTIT": "want wants need crave love dying envie will will mochte veux quiero quieres ganas desire long wish wanna feel",
    "OFFER": "escort(s) hookup hookups callgirl prostitute nutten escorte putas",
    # contexts
    "REPNOUN": "comment message quote wording policy slogan graffiti sentence phrase example review transcript article novel song lyrics text post report rule line word words slur slurs insult insults term complaint note email letter chat log statement remark character kommentar nachricht zitat satz spruch parole wort worte beschwerde bericht text commentaire message citation phrase slogan mot mots plainte rapport texte comentario mensaje cita frase lema palabra palabras queja informe texto",
    "SAY": "shouts shout screams screamed whispers cries exclaims mutters replies replied tells told answers tweets tweeted posted sings sang sprach schreit rufe ruft hurle lance grita contesta say says said saying quote quotes quoted wrote written write writes call calls called calling contained contains contain reads read insult insulted insults used uses using shouted yelled sprayed removed reported flagged banned moderated deleted forbids forbid forbidden prohibits prohibited blocked bans allowed withheld reviewed tagged states claims claimed alleged accused sagt sagte schrieb geschrieben nannte genannt zitiert enthielt entfernt gemeldet verboten verbietet rief dit disait ecrit appele traite contenait supprime signale interdit interdits cite cria dice dijo escribio llamo escrito llamado contenia eliminado reportado prohibido prohibe cita gritaba grito",
    "TECH": "brochure leaflet poster exhibit exhibition label product products title puzzle box lipstick shades cosmetics specimen screening trap manual cable queue script job worker batch schadlinge lager flyer affiche entrepots depistage catalogue especimen ejemplar etiqueta cartel almacenes farm slide sheet etiquette comparison anatomy medical patient clinic surgery museum painting sculpture biology species zoo veterinary breeding ausstellung plakat etikett anatomie medizinisch exposition anatomia medico especie museo research study studie etude estudio education aufklarung prevention",
}

#: Classes whose words are looked for in disguise.
DISGUISED = ("INSULT", "SWEAR", "SHUTUP", "VERMIN", "PORN", "SEX", "NAKED", "HORNY", "FUCK", "BREAST", "TITS", "GROUP", "SLUR", "EXTERMINATE", "SCREW", "CRIMINAL", "KILLSELF", "DIE", "CRAPNOUN", "YOURSELF")

#: Compounds: a first part that makes an insult of any insult or animal, and last parts that make one of the first.
INSULT_PREFIXES = "voll drecks scheiss sau erz ober mega super mist arsch fucking dumb shit".split()
INSULT_HEADS = "dick shit ass arse butt fuck cunt cock crap dumb scum dirt douche sleaze slime fart piss meat bone thick block".split()
INSULT_TAILS = "head face bag hole wit wipe tard hat stain breath brain stick clown weasel rag licker sucker".split()

#: Sub-transducers; _ is any word but a negation.
PARTS: dict[str, str] = {
    "MOD": "(DET | ADV | ADJ | ADJMILD | SWEAR | CRAPNOUN | ADV and)*",
    "OFCRAP": "(de | of | a | du | des) (la)? CRAPNOUN",
    "PIECEOF": "PIECE (of | de | d | a | voll) (DET | ADJ | SWEAR)* (INSULT | CRAPNOUN | SOFT) | stuck (CRAPNOUN | SWEAR) | (son | sons) of a (INSULT | SWEAR | gun) | (hijo | hijos | hija) de (la)? (gran)? (INSULT | perra) | fils de (INSULT | chien | chienne)",
    "BAD": "@MOD (INSULT | @PIECEOF) (@OFCRAP)?",
    # a person: what is an insult only of people counts too
    "BADONE": "@MOD (INSULT | @PIECEOF | SOFT | SLUR) (@OFCRAP)?",
    "YOUARE": "YOU (guys | all | people | lot | bunch | clearly | WILL | MODAL)? (ARE | BE) | (ARE | BE) YOU | YOUARE",
    "SUBJ": "(I | WHO | THEY | @THEIRMEN)",
    "THEIRMEN": "MY (_)? _",
    "LOOSE": "(_){0,2}",
    "BOUND": "(EDGE | AND | CONJ | UPON | WITH | YOU | YOUARE)",
    # the threatened: you, or a part or a relative of yours
    "VICTIM": "(YOU | YOUR (_)? (BODY | KIN | PROPERTY | HAVES) | YOUR (whole | entire | fucking)? (KIN | BODY))",
    "G": "(DET | ADJ | SWEAR | ADV)* (GROUP | SLUR | _ TRIBE | GROUPADJ FOLK | FOLK (of | from | du | des | de | del | with)? (DET)* OFGROUP | FOLK (of | from | du | des | de | del) (_){1,2} | OFGROUP FOLK | GROUP (FOLK | PERSON)) ",
    "VILE": "(DET | ADV | ADJ | SWEAR | but)* (VERMIN | CRIMINAL | INFERIOR (LOWERKIND | FOLK)? | burden | plague | problem | mistake | freak | freaks | disgrace | waste | shame | schande | honte | verguenza | last | belastung | fardeau | carga | INSULT | ADJ | (DET)? (lower | lesser) LOWERKIND | born (_)? ADJ | lazy by nature | lazy)",
}

#: (category, weight, rule). A clause scores the highest weight of its matches, changed by context and gaps.
RULES: list[tuple[str, float, str]] = [
    # insults of the person addressed
    ("abusive", 0.9, "@YOUARE (_){0,2} @BADONE"),
    ("abusive", 0.9, "@YOUARE (ADV | ADJMILD | SWEAR | as | a | _ DET)* ADJ"),
    ("abusive", 0.9, "@YOUARE (SWEAR)+ (ADJ | ADJMILD | _)"),
    ("abusive", 0.9, "(YOU | YOUR) (ADV | ADJMILD | ADJ | SWEAR | ARE)* (INSULT | SLUR | @PIECEOF)"),
    ("abusive", 0.9, "(YOU | YOUR) (ADV | ADJMILD)* (ADJ | SWEAR) (ADJ | SWEAR | ADJMILD | _)* (SOFT | SLUR)"),
    ("abusive", 0.9, "YOU (_)? (ADJ | SWEAR)+ EDGE"),
    ("abusive", 0.85, "EDGE (ADJ | SWEAR | ADJMILD | ADV | DET)* (INSULT | @PIECEOF) (@OFCRAP)? EDGE"),
    ("abusive", 0.85, "EDGE (ADJ | SWEAR)+ (SOFT) EDGE"),
    ("abusive", 0.9, "(hello | hey | oi | listen | look | espece | pauvre | sale | gros | so | oye | eh) (DET | de | ein)* (ADJ)* (INSULT | SLUR)"),
    ("abusive", 0.9, "INSULT @OFCRAP"),
    ("abusive", 0.9, "@PIECEOF EDGE"),
    ("abusive", 0.9, "this BE (SWEAR | CRAPNOUN) AND YOU (_)*"),
    ("abusive", 0.9, "@YOUARE (ADV)* (nothing | nobody | rien | nichts | nada | nadie) EDGE"),
    ("abusive", 0.9, "(hey | hi | oi | listen | hor zu | ecoute | oye) ADJ EDGE"),
    ("abusive", 0.9, "YOUR (_)? KIN (BE)? (ADV | DET | SWEAR | ADJMILD)* (ADJ | INSULT | SOFT)"),
    ("abusive", 0.9, "(how | wie | que | comme | so) (ADV)* (ADJ | INSULT) YOU (ARE | BE)"),
    ("abusive", 0.85, "(THEY | @THEPERSON) BE (ADV | DET)* (ADJ | SWEAR)+ (ADV | ADJMILD)* SOFT @BOUND"),
    ("abusive", 0.9, "(WHAT | such | quel | quelle | que) (DET | ADV)* (ADJ | SWEAR)+ SOFT (YOU | EDGE YOU)"),
    ("abusive", 0.85, "crawl (back | away) (under | into | to)? (YOUR | DET)? (_)? (rock | hole | cave)"),
    ("abusive", 0.9, "(EDGE | AND) (YOU | GO) (SWEAR)* SHUTUP"),
    # dismissals
    ("abusive", 0.9, "SHUT YOUR? (DET | YOUR | ADJ | SWEAR)* (SHUTUP | mouth | trap | pie hole | mund | boca | pico | bouche)"),
    ("abusive", 0.9, "shut (SWEAR | the | _)? up (EDGE)? @BADONE"),
    ("abusive", 0.9, "shut (SWEAR | the){1,2} up"),
    ("abusive", 0.9, "stfu | kys | gtfo"),
    ("abusive", 0.9, "DISMISS (YOU | EDGE | YOURSELF | t)* (ADJ | DET)* (INSULT | @PIECEOF)"),
    ("abusive", 0.85, "(verpiss | verpisst | fick | leck) (OFFWORD | YOU)"),
    ("abusive", 0.85, "(SCREW | fick | nique) YOUR KIN"),
    ("abusive", 0.85, "(SCREW | go SCREW) (you | u | off | yourself | yourselves | dich | euch | ta mere | ta race | ta | mich am | ton)"),
    ("abusive", 0.85, "(va | vas | allez) (te | vous) (faire)? (SCREW | FUCK | foutre | SUCK | DIE)"),
    ("abusive", 0.85, "(que te | vete a) (jodan | den | la mierda | tomar por culo | follen | chingar)"),
    ("abusive", 0.85, "(GET | just) (the)? (SWEAR | to | the | out of | DET)* LOST (EDGE)? (YOU | YOUR | DET)? (ADJ | SWEAR | ADJMILD)* (INSULT | SOFT)"),
    ("abusive", 0.85, "(piss | fuck | bugger) off"),
    ("abusive", 0.85, "(go to | rot in | burn in | schmor in der | pudrete en el | arde en el | brule en) (hell | holle | infierno | enfer)"),
    ("abusive", 0.8, "(get lost (EDGE | YOU) | fous le camp | zum teufel mit dir | geh zum teufel)"),
    ("abusive", 0.85, "(eat | friss | mange | come) (DET | MY | YOUR | la)* (SWEAR | CRAPNOUN)"),
    ("abusive", 0.85, "NOBODY (_){0,3} (care | cares | cry | notice) (if | when) YOU (_)? (DIE | died | vanish | _)"),
    ("abusive", 0.85, "as ADJ as YOU"),
    ("abusive", 0.85, "take YOUR (ADJ | SWEAR)+ _ WITH you"),
    # insults by comparison, shame and exclusion
    ("abusive", 0.9, "(HAS)? MORE (_)? BRAINS THAN YOU"),
    ("abusive", 0.9, "YOU HAS DET? BRAINS (of | von | de | d | wie) (_)*"),
    ("abusive", 0.9, "YOU (HAS | MODAL | NEG)* (NEG | no | zero | null | aucun | ningun) (DET | a | de)* BRAINS"),
    ("abusive", 0.9, "YOU (SMELL | SMELL (a | nach | a)) (LIKE | nach | a)"),
    ("abusive", 0.85, "YOU SMELL EDGE"),
    ("abusive", 0.85, "YOU (_)? LOOK LIKE (DET | _)* (LOUSY | ADJ | INSULT | SOFT | SWEAR)"),
    ("abusive", 0.8, "(dog | cat | monkey | child | toddler | potato | parrot | hund | affe | chien | singe | perro | mono | SOFT) (_){0,6} BETTER (_){0,3} THAN YOU"),
    ("abusive", 0.85, "(ADJ | dumber | uglier | thicker | MORE ADJ) THAN (a | an | DET) _"),
    ("abusive", 0.85, "YOUR (_)? FACE (RUIN | makes (me | us) (sick | vomit | puke))"),
    ("abusive", 0.85, "YOU (make | makes) (me | us) (sick | vomit | puke)"),
    ("abusive", 0.85, "(even | everyone | everybody | NOBODY | jeder | alle | tout le monde | todos | todo el mundo) (_){0,3} AVOID (at | uber | sich | de | about)? (YOU | behind YOUR back)"),
    ("abusive", 0.85, "NOBODY (_){0,2} (likes | loves | wants | asked | mag | aime | quiere | soporta) YOU"),
    ("abusive", 0.85, "(laughs | laugh | laughing) (at YOU | behind YOUR back)"),
    ("abusive", 0.9, "(YOUR (_){0,2} _ (MODAL | be | BE)* | YOU MODAL (be)? ) ASHAMED"),
    ("abusive", 0.9, "ASHAMED (of | that | to | fur | de | que | uber) (_){0,4} (YOU | YOUR | failure)"),
    ("abusive", 0.9, "YOU (_){0,2} WASTE (of | an | de) AIR"),
    ("abusive", 0.9, "(WHAT | such) (DET | ADJ | SWEAR | ADV)* (INSULT | @PIECEOF) @BOUND"),
    ("abusive", 0.85, "(quel | quelle | menudo | menuda | vaya) (ADJ | SWEAR)* (INSULT | SOFT) (EDGE | YOU)"),
    ("abusive", 0.85, "what a (ADJ | SWEAR | ADV)* (INSULT | SOFT) EDGE (_)* NEG"),
    ("abusive", 0.9, "(what | which | welche | quel | que) (kind | sort | type | art | genre | clase) (of | von | de) @BAD"),
    ("abusive", 0.9, "(only | nur | solo | seul | seule) (DET | ADJ | SWEAR | ADV)+ (INSULT | SOFT) (MODAL | WILL | UPON | THEY)"),
    ("abusive", 0.9, "(WHO | so etwas | sowas | PERSON) (_){0,4} (BE | UPON | THEY){1,2} (nur | only | just)? @BAD @BOUND"),
    ("abusive", 0.85, "WHO (_){0,4} BE DET (_)? (SOFT | _) EDGE plain"),
    ("abusive", 0.85, "WHO (_){0,4} BE (DET)? (ADV | ADJ | SWEAR)* (SOFT) @BOUND"),
    ("abusive", 0.9, "(il faut | hay que | you must | must | have to | takes) (etre | ser | be | a | an | special | DET | to)+ (ADJ | SWEAR | DET)* (INSULT | SOFT) (pour | para | to | EDGE)"),
    ("abusive", 0.85, "(THEY | WHO | @THEPERSON) BE (ADV | SWEAR | ADJMILD)* DET (ADV | ADJ | SWEAR | ADJMILD | ADV and)* (INSULT | @PIECEOF) EDGE"),
    ("abusive", 0.85, "(ARE | BE) YOU (SWEAR)+ _"),
    ("abusive", 0.85, "(ARE | BE) YOU (SWEAR)? (ADJ | ADJMILD | deaf | mental) (or | oder | ou | o) (just | only | SWEAR)* (ADJ | _)"),
    # threats
    ("abusive", 0.9, "@SUBJ (WILL | MODAL | to | be | should | ought | _)* HURT (_)? @VICTIM"),
    ("abusive", 0.9, "@SUBJ (WILL | MODAL | to | be | should | ought | _)* (HURT | HANDLE) (_){0,2} (from)? (YOU | YOUR) (_)? (BODY | KIN)"),
    ("abusive", 0.9, "@SUBJ (WILL | MODAL | to | be | should | ought | _)* HANDLE (YOU | YOUR KIN) (_){1,3} PLACE"),
    ("abusive", 0.85, "(bullet | knife | axe) (_){0,2} (in | through | between) YOUR (_)? BODY"),
    ("abusive", 0.9, "(bring | bringe | bringen) YOU (_)? um"),
    ("abusive", 0.9, "(beat | kick | knock | smack | punch | slap) (the | living)+ (_)? out of YOU"),
    ("abusive", 0.85, "teach YOU a lesson"),
    ("abusive", 0.9, "(I | WHO) (_)? (WILL | MODAL | ll) (_)? (make | have) YOU (_)? REGRET"),
    ("abusive", 0.9, "YOU (_)? (WILL | MODAL | ll | vas | vais) (_)? REGRET (this | it | that | for | das | dafur | ca | esto | EDGE)"),
    ("abusive", 0.9, "I (WILL | MODAL)? YOU (_){0,3} (HURT | BODY HANDLE)"),
    ("abusive", 0.9, "(I)? (HURT | mach | mache) YOU (kalt | fertig | um | tot | (DET)? BODY | platt)"),
    ("abusive", 0.9, "(I)? (HURT | HANDLE) YOU (DET) (_)? BODY"),
    ("abusive", 0.9, "YOU (voy | vais | va | vamos) (_){0,2} (HURT | HANDLE (_){0,2} BODY)"),
    ("abusive", 0.9, "(I | WILL) (WILL)? YOU HURT"),
    ("abusive", 0.9, "(voy | vamos | WILL) a HURTYOU"),
    ("abusive", 0.9, "YOU (mato | matare | creve | tue | bute | egorge)"),
    ("abusive", 0.9, "@SUBJ (WILL | MODAL | ought | to)* (HURT | HANDLE) YOUR (_)? BODY (_){0,2} (off | out)"),
    ("abusive", 0.9, "(YOU | THEY | WHO | @THEPERSON) (MODAL | DESERVE) (to)? (be)? (shot | hanged | beaten | killed | raped | stabbed | gassed | burned | hung | HURT | die)"),
    ("abusive", 0.9, "YOU (ARE | re | WILL be | BE) (a | so | ein | un)* DEADMAN (meat | man | EDGE)"),
    ("abusive", 0.9, "YOUR days are numbered"),
    ("abusive", 0.95, "KILLSELF (yourself | yourselves | dich um | dich auf | dich | toi | te)"),
    ("abusive", 0.95, "(matate | suicidate | ahorcate | cuelgate | tirate de un puente | suicide toi | bring dich um)"),
    ("abusive", 0.9, "(GO | EDGE) (and)? (DIE | drink bleach | drop dead | jump off (a | the)? (bridge | roof | cliff | building)) (EDGE | YOU | in a fire | slowly | already)"),
    ("abusive", 0.9, "(verrecke | verreck | krepier | stirb | creve | muerete) (EDGE | YOU | endlich | doch)"),
    ("abusive", 0.9, "I (_){0,2} KNOW (EDGE)? (WHERE | exactly)+ (YOU | YOUR | desk | car | house) (_){0,3} (LIVE | kids)"),
    ("abusive", 0.9, "I (_)? KNOW YOUR (way | address | street | house | KIN) (_)?"),
    ("abusive", 0.9, "KNOW (EDGE)? WHERE (YOU | YOUR)? (_)? LIVE"),
    ("abusive", 0.9, "KNOW (which | what) _ BE yours"),
    ("abusive", 0.9, "WATCH (out)? YOUR (back | rucken | mouth | tongue | mund)"),
    ("abusive", 0.9, "(sleep | schlaf) (_){0,4} (eye | BEWARE | auge)"),
    ("abusive", 0.9, "(mefie | cuidate | pass) (YOU | te | toi | auf)? (_)? (esta noche | ce soir | heute nacht | tonight)"),
    ("abusive", 0.85, "better (pray | hide | run)"),
    ("abusive", 0.85, "(dreh | schlaf) (dich | heute) (_){0,2} (lieber | besser | nicht)"),
    ("abusive", 0.9, "HOPE (_){0,3} YOU (_){0,2} (DIE | rot | bleed | choke | drown | suffer | burn | crash | stirbst | verreckst | creves | mueras | sufras | krepierst)"),
    ("abusive", 0.9, "HOPE (_){0,2} YOU (get | HAS | bekommst | attrapes | tengas | pierdas | lose | perdes | verlierst) (_)? (cancer | krebs | raped | HAVES | YOUR (_)? HAVES | HEAVY)"),
    ("abusive", 0.9, "HOPE (_){0,2} (HEAVY | KIN | house | _) (_){0,2} (HARM | hits | runs) (_){0,2} (on | over | with | auf | sur | sobre | down)+ (YOU | with YOU | _)"),
    ("abusive", 0.9, "HOPE (_){0,4} (hits | kills | crushes | burns) YOU"),
    ("abusive", 0.9, "HOPE YOUR (_)? KIN (_)? (DIE | HARM | get HEAVY)"),
    ("abusive", 0.9, "HOPE (que)? YOU (atropelle | aplaste | renverse | get hit by) (DET)? (HEAVY | _)"),
    ("abusive", 0.85, "(FAVOUR | nice | nett | gentil | amable) (_){0,4} AND (_ | NEG | never | nie){0,4} DISAPPEAR"),
    ("abusive", 0.85, "NOBODY (_ | NEG){0,3} MISS YOU"),
    ("abusive", 0.85, "NOBODY (_ | NEG){0,1} YOU (_){0,3} MISS"),
    ("abusive", 0.85, "YOU (_)? MISS NOBODY"),
    ("abusive", 0.85, "(world | everyone | team | welt | monde | mundo | we | us) (_){0,4} BETTEROFF (off)? (_)? WITHOUT YOU"),
    ("abusive", 0.9, "(wish | hoped) YOU (_)? (NEG)? (_)? (never)? (been)? (born | dead)"),
    # attacks on groups
    ("hateful", 0.9, "@G (all | alle)? (BE | LOOK LIKE | MODAL | THEY | EDGE)+ (_)? @VILE"),
    ("hateful", 0.85, "DET (_){1,2} BE (DET | ADV)* VERMIN (AND | EDGE) (_){0,4} (OUT | EXPEL | EXTERMINATE)"),
    ("hateful", 0.9, "(all | alle | tous | todos) (_){1,3} BE (DET | ADV)* VERMIN EDGE (send | back | raus | dehors | fuera | _){1,3}"),
    ("hateful", 0.9, "@G (BE | EDGE)* (_){0,2} (INFERIOR | born)"),
    ("hateful", 0.9, "(EXTERMINATE | EXPEL) (out | off | all | every | last | one | of | these | the | DET | alle | tous | todos | a | away | back | those | zu | to | au | aux)* (_)? @G"),
    ("hateful", 0.9, "@G (_){0,3} MODAL (BE | all | alle | _){0,3} (EXTERMINATE | EXPEL)"),
    ("hateful", 0.9, "(MODAL | man | on | should | must | faut | hay | habria) (_){0,2} @G (_){0,2} (EXTERMINATE | EXPEL)"),
    ("hateful", 0.9, "@G OUT (EDGE | @BOUND | aus | of | from | hier | here | de | d)"),
    ("hateful", 0.9, "@G (_){0,5} AND MODAL (BE)? (_)? (EXTERMINATE | EXPEL | destroyed | eliminated | crushed)"),
    ("hateful", 0.85, "(cant | cannot | dont) (stand | bear | tolerate) (DET | SWEAR | these | those)* @G"),
    ("hateful", 0.9, "(drive | throw | kick | chase | hunt | push | force | run | jag | jagt | werft) (DET | all | those | these | _)* @G (_){0,2} (OUT | away | from)"),
    ("hateful", 0.9, "@G (_ | EDGE){0,8} (EXPEL | EXTERMINATE) (THEM)"),
    ("hateful", 0.9, "@G (_ | EDGE){0,8} (MODAL | we | man | on) (que | on | MODAL)* THEM (_)? (EXPEL | EXTERMINATE)"),
    ("hateful", 0.85, "@G (BE | ADV)+ (stealing | raping | invading | ruining | destroying | polluting | infesting | replacing) (_){0,2}"),
    ("hateful", 0.9, "(fuera | raus mit | weg mit | dehors | out with) (DET | den | los | les)* @G"),
    ("hateful", 0.9, "@G (_){0,6} EDGE (_){0,2} (OUT | send them (back | home | away | _))"),
    ("hateful", 0.9, "(send | ship) (them | DET | all | @G)+ (back | home | away)"),
    ("hateful", 0.85, "go back to (YOUR | where) (_)? (COUNTRY | came | come | from | YOU)"),
    ("hateful", 0.9, "@G (do | does | MODAL | WILL | NEG | HAS | _)* NEG (DESERVE | EQUAL | be | HAS)* (DESERVE | EQUAL | human | menschen)"),
    ("hateful", 0.9, "NEG (DESERVE | EQUAL) (_){0,3} @G"),
    ("hateful", 0.9, "NEG (more)? @G (allowed | welcome | here | erwunscht | please)"),
    ("hateful", 0.9, "rid of (DET | all | these | those)* (_)? @G"),
    ("hateful", 0.9, "@G (HAS | ont | haben | tienen)? (NEG | hier)+ (_){0,2} (EQUAL | here | hier | ici | aqui)"),
    ("hateful", 0.9, "@G (all | always | only | ADV | just | EDGE | THEY)* BREED (too | AND | like | EDGE | _)"),
    ("hateful", 0.9, "@G (_){0,6} in (their | DET | ihrem) (blood | nature | genes)"),
    ("hateful", 0.9, "@G (MODAL)? BELONG (_){0,2} KITCHEN"),
    ("hateful", 0.9, "NEG (_){0,3} (REFUSE | HIRE) (_)? (WITH)? @G"),
    ("hateful", 0.9, "(refuse | lehne | niego | refuses | wont) (_){0,2} (REFUSE | HIRE) (WITH)? (_)? @G"),
    ("hateful", 0.9, "(WITH) @G (REFUSE) (_){0,2} NEG"),
    ("hateful", 0.9, "WHY (_){0,2} HIRE (DET)? @G (at all)? (EDGE | BE)"),
    ("hateful", 0.9, "HATE (all | alle | tous | todos | these | those | diese | DET | a | fucking | SWEAR){0,3} (_)? @G"),
    ("hateful", 0.9, "(SWEAR | ADJ | dirty) (GROUP | SLUR)"),
    ("hateful", 0.9, "(DOWNWITH) (to | with | den | der | aux | a | los | dem | DET)* @G"),
    ("hateful", 0.9, "(YOU | YOUR | all | these | those | ADJ | EDGE | DET | fucking) (_)? SLUR"),
    ("hateful", 0.9, "BURN (down | in | ein | the | DET | all | _)* PROPERTY (of | von | der | des | de | where) (_)? @G"),
    ("hateful", 0.9, "BETTER (_)? BEFORE (_){0,8} @G"),
    ("hateful", 0.9, "BEFORE (_){0,5} BETTER EDGE (_){0,6} @G"),
    ("hateful", 0.9, "BETTER EDGE BEFORE (_)? CAME (_){0,3} @G"),
    ("hateful", 0.85, "@G (CAME | BE CAME | _){0,4} (ruin | ruined | destroy | destroying | infest | invade | overrun | taking) (_){0,3} (COUNTRY | town | city | us | over | everything)"),
    # sexual
    ("sexual", 0.9, "HOT (HOT | _)? (PORN | SEX MEDIA | NAKED GIRLS | NAKED MEDIA)"),
    ("sexual", 0.9, "(PORN | SEX) (HOT | _)? (MEDIA | now | live | gratis)"),
    ("sexual", 0.9, "(MEDIA) (de)? PORN"),
    ("sexual", 0.85, "PORN (_){0,4} (link | lien | enlace | here | hier | ici | aqui)"),
    ("sexual", 0.8, "NAKED GIRLS"),
    ("sexual", 0.8, "GIRLS (_)? NAKED"),
    ("sexual", 0.8, "xxx (_)? (night | videos | movies | live)"),
    ("sexual", 0.9, "SENDME (I | me | DET | MY | us)* (YOUR | DET | of | some | your)* (_){0,2} (PORN | NAKED | BREAST)"),
    ("sexual", 0.9, "SENDME (I | me)? (_){0,4} (of | de | von)? YOU (DET | a | in | YOUR)* NAKED"),
    ("sexual", 0.9, "SENDME (I | me)? (YOUR) (SEXADJ)* TITS"),
    ("sexual", 0.9, "SUCK (on | DET | him | her | off)? (MY | YOUR | THEIR | DET) (SEXADJ | _)? TITS"),
    ("sexual", 0.9, "SUCK (I | mir | me) (DET | off) (TITS)?  TITS"),
    ("sexual", 0.9, "(MY | YOUR | THEIR) (SEXADJ)+ (TITS | BREAST)"),
    ("sexual", 0.85, "(YOUR | THEIR) BREAST"),
    ("sexual", 0.9, "STARE (at | auf | a | DET)? YOUR (_)? TITS"),
    ("sexual", 0.9, "(I | WANTIT | come | komm | viens | ven | vamos) (_){0,8} FUCK (I | YOU | me | hard | with | EDGE)"),
    ("sexual", 0.9, "(WANTIT | WILL) (_){0,2} FUCK (I | YOU | her | him)"),
    ("sexual", 0.9, "(WANTIT | gonna | WILL) (de | to | te | dich | YOU | mit)* (YOU) FUCK"),
    ("sexual", 0.9, "FUCK (I | me) (hard | now | harder | tonight | baby | all night | EDGE)"),
    ("sexual", 0.9, "(vamos | ganas | quiero) (a | de)? FUCK"),
    ("sexual", 0.85, "(to | hard | zu | de | a) FUCK (me | her | him | them | YOU)"),
    ("sexual", 0.9, "WANTIT (_){0,2} (YOU | verte | tenerte) (_)? NAKED"),
    ("sexual", 0.85, "(sit | ride | come) on MY (face | TITS)"),
    ("sexual", 0.85, "(see | watch | feel | suck | want) (MY | YOUR) (SEXADJ)* TITS (EDGE | _)"),
    ("sexual", 0.85, "(touching | playing with | fingering | touch) (myself | yourself | herself | himself) (while | and | thinking | EDGE | for)"),
    ("sexual", 0.9, "(MY | YOUR | THEIR) TITS BE (so | very)? (SEXADJ | HORNY) (for | AND | EDGE | _)"),
    ("sexual", 0.9, "(MY | YOUR | THEIR) (SEXADJ)* TITS (LICK | SUCK | FUCK)"),
    ("sexual", 0.9, "SEXADJ BREAST AND SEXADJ (TITS | pussies)"),
    ("sexual", 0.85, "HOT GIRLS (_){0,2} (strip | naked | online | waiting | dancing | UNDRESS)"),
    ("sexual", 0.85, "WANTIT (_){0,2} PORN"),
    ("sexual", 0.85, "(took | takes | take | taking | pounds | pounding | thrust | thrusts | fucks) (her | him | me | you) (_)? (from behind | hard | deep)"),
    ("sexual", 0.85, "WANTIT (_){0,2} (mit YOU (ins bett | schlafen) | coucher avec YOU | acostarme contigo | sleep WITH YOU tonight)"),
    ("sexual", 0.9, "WANTIT (_)? LICKYOU"),
    ("sexual", 0.85, "WANTIT (_){0,2} (LICK YOU | YOU LICK)"),
    ("sexual", 0.85, "(looking | search | searching | suche | cherche | busco) (for)? (_){0,3} (PORN | SEX | FUCK) (EDGE | tonight | now | with | partner | heute | ce | esta)"),
    ("sexual", 0.85, "(spread | spreads | spreading | open | opens) (THEIR | YOUR | MY) legs"),
    ("sexual", 0.9, "(make | made) (YOU | I | me | her | him) CUM"),
    ("sexual", 0.9, "CUM (in | on | inside | over) (MY | YOUR | THEIR | me | you | her)"),
    ("sexual", 0.9, "(I | BE | so | bin | suis | estoy | EDGE) (so | ADV)? (horny | geil | cachondo | cachonda | aroused | excitee) (AND | EDGE | for | come | _)"),
    ("sexual", 0.9, "(I | we) (_)? WANTIT (_){0,2} (TOUCH | UNDRESS) (_){0,2} (YOU | YOUR) (_){0,8} SENSUAL"),
    ("sexual", 0.9, "(I | we) (_)? WANTIT (_){0,2} TAKE (YOUR) CLOTHES (_){0,12} (SENSUAL | YOU)"),
    ("sexual", 0.9, "(I | we) (_)? WANTIT (_){0,2} (TOUCH) (every inch of | YOU AND) (_){0,8} (YOU | SENSUAL)"),
    ("sexual", 0.9, "UNDRESS (YOU | te | toi | fur | for | dich)* (_ | EDGE){0,8} (SENSUAL | I | me | moi | mich | mir)"),
    ("sexual", 0.9, "(TAKE | zieh) (off | mit | DET | YOUR | der | la | les | den)* CLOTHES (off)? (and | AND | fur | for | _){1,6} (I | me | SENSUAL | mich)"),
    ("sexual", 0.9, "(zieh) dich (_)? aus (_ | EDGE){0,8} (mich | mir | SENSUAL)"),
    ("sexual", 0.9, "(POSE) (YOU | te | toi | dich | down)? (on | auf | over | sur | en | onto)? (MY | the | a | mein | meinem | DET)? (ONME | desk | table | tisch) (AND | EDGE) (_){0,4} (I | MY | tongue | SENSUAL)"),
    ("sexual", 0.9, "I (_){0,2} show YOU what MY _ (BE) for"),
    ("sexual", 0.9, "(THEY | THEIR) (BE)? MOAN (_){0,3} (it | more | MOAN | while | as)"),
    ("sexual", 0.9, "SHOWS (_){0,6} DOINGIT IT (_){0,8} SCENE"),
    ("sexual", 0.9, "SHOWS (_){0,6} DOINGIT (at)? IT (_){0,6} EDGE (_){0,4} (SCENE | left out | no clothes)"),
    ("sexual", 0.9, "COUPLE DOINGIT (at)? it (_){0,5} EDGE (_){0,4} (SCENE | clothes)"),
    ("sexual", 0.85, "(have | having | want | wants | wanna | looking for) (hot | HOT | SEXADJ | wild | anonymous | casual | oral | anal)* (sex | blowjob | threesome) (with | tonight | now | EDGE)"),
    ("sexual", 0.85, "(lets | let s) (have | _)? (sex | FUCK)"),
    ("sexual", 0.85, "OFFER (_){0,3} (GIRLS | tonight | service | services | cheap | hot)"),
    ("sexual", 0.85, "BREAST (AND | EDGE) (TITS | BREAST)"),
]
PARTS["THEPERSON"] = "(DET | MY | YOUR | that) (_)? (PERSON | KIN)"

#: Context: words a negation reaches, words a report reaches, and the words after a report noun that wait for the verb.
NEG_REACH, REPORT_REACH, NOUN_REACH, FIRST_REACH = 3, 12, 5, 3
#: What a match in such a context costs, in hundredths of a logarithm.
CONTEXT_COST = {"negated": 92, "reported": 92}
#: A clause with technical words lowers matches of rules below TECH_SURE.
TECH_SURE, TECH_FACTOR = 0.86, 0.65
