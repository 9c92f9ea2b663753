"""Sentences for the content grammar, written without the test tables at hand; each set of clean ones has the
others' words in harmless use. FIRST was written before the grammar and used to mend it; SECOND, THIRD and FOURTH were
written later, and were unseen when they were first scored (28 of 42, 34 of 42 and 33 of 51 found; 3 of 42,
none of 42 and 1 of 43 harmless ones flagged); then the grammar was widened by what they had missed."""

FIRST_BAD = """
go kill yourself
You're a worthless piece of garbage
kill all muslims
These foreigners are nothing but criminals
hijo de puta
va te faire foutre
Ausländer raus
retarded clown
f u c k off
nobody called you an idiot but you are a moron
You are such a disgusting excuse for a human, you pathetic worm
I swear I'm going to smash your face in
We know where your kids go to school
Someone ought to put a bullet in your head
I hope you get cancer and die
your mother is a whore
shut your filthy mouth, you parasite
What kind of moron writes this
Every single one of you is a useless idiot
you people are braindead
He is a lying piece of shit
eat shit and die
drop dead, loser
get the fuck out of here you bastard
you make me sick
the world would be better off without you
Nobody would care if you died
Your kid is as ugly as you are
I'll find you and cut your throat
You will pay for this, I know your address
jump off a bridge
I'm going to rape you
Deport all immigrants now
Gas the jews
Muslims are animals and should be shot
Black people are genetically inferior
I hate gypsies, they are all thieves
Gays should be burned alive
women belong in the kitchen
go back to your country, you dirty paki
no blacks allowed here
all refugees are rapists
We need to get rid of the jews
Send those immigrants back to Africa
Disabled people are a burden and should be put down
never trust a gypsy
foreigners don't belong here
those faggots disgust me
send me a picture of your tits
suck my dick
I want to lick your pussy all night
She spreads her legs and begs him to fuck her
hot teen girls naked on webcam
let's have sex in the archive
click here for free xxx movies
I'm so horny right now, come over and ride me
show me your naked body, baby
he shoves his hard cock into her
my wet pussy is waiting for you
sell me your nudes
looking for a quick blowjob tonight
I want you naked in my bed
Du dreckiger Hurensohn
Halt dein Maul, du Opfer
Ich bringe dich um
Ich schlag dir die Zähne ein
Fick dich
Du bist so dumm wie Brot
Geh sterben
Ihr seid alle Idioten
Wir wissen, wo du wohnst
Du bist echt das Letzte, du Arschloch
Juden sind Ungeziefer
Alle Ausländer sind Verbrecher
Flüchtlinge gehören abgeschoben
Schwule sollte man wegsperren
Zigeuner klauen alle
Ich hasse Türken
Zeig mir deine Titten
Ich will dich ficken
Lutsch meinen Schwanz
Ich bin so geil auf dich
Kostenlose Pornos hier
Ferme ta gueule
Espèce de connard
Tu es vraiment un abruti
Je vais te tuer
Va crever, sale chien
Je vais te casser la gueule
T'es qu'une merde
Nique ta mère
Pauvre con
Les arabes sont tous des voleurs
Mort aux juifs
Les immigrés dehors
Il faut renvoyer tous les étrangers
Je déteste les noirs
Suce ma bite
J'ai envie de te lécher partout
Montre-moi tes seins
Vidéos porno gratuites
Eres un imbécil
Vete a la mierda
Te voy a matar
Cállate la boca, estúpido
Eres una basura
Me das asco, hijo de perra
Los inmigrantes son criminales
Fuera moros de aquí
Hay que expulsar a todos los extranjeros
Odio a los gitanos
Los negros son inferiores
Chúpame la polla
Quiero follarte toda la noche
Enséñame las tetas
Sé donde vive tu familia
Ojalá te mueras
Púdrete en el infierno
yo u are an 1d10t
k1ll y0urself
you fcuking m0ron
what an a$$hole you are
stupid b!tch
You absolute waste of oxygen
Only an imbecile could have scanned this
are you deaf or just stupid
why don't you just kill yourself
one day someone will break your legs
you deserve to be beaten
you're dead meat
sleep well, it may be your last night, I know where you park
my dog writes better reports than you
a trained monkey could do your job better than you
you have the brain of a goldfish
you stink like a sewer
""".strip().split("\n")
FIRST_GOOD = """
We want to touch base with you
Your ass is a farm animal listed on page two.
My cock is a prize rooster.
The report quotes him saying you are an idiot.
I do not think you are an idiot
Nobody called you an idiot
The user was banned because he wrote "kill all muslims" in the chat
She complained that a colleague called her a bitch
The novel contains the sentence "you are a worthless piece of garbage"
Kill the process and restart the server
The children killed time before the bus came
Muslims are welcome in our community centre
Refugees need shelter and food
The museum shows photographs of immigrants from 1920
Women should have equal rights
Rats are vermin and spread diseases
All pigeons in the warehouse are pests and were removed
Parasites are animals that live on a host
You are right and I was wrong
You are the best colleague I have
You are so kind
I hope you feel better soon
I hope you do not lose your files
I know where you put the folder
We know where you can find the documents
Please send me the pictures of the building
Send me your photos of the conference
Show me your slides
The naked mole rat is a rodent
The nude painting hangs in room three
Breast cancer screening is free for women over fifty
The patient has pain in the anus and the penis
Sex: female, age: 34
The sex of the animals was recorded
Sex education is taught in year nine
The dog is a bitch of three years
The jackass is a male donkey
A bastard file is a tool for metal
The cunning plan worked
Shut up the window shutters before the storm
Shut down the server
Get lost luggage back with this form
The idiot light on the dashboard is red
He is an idiot in Dostoevsky's famous novel, and the cover scan is upside down
I will break the archive into parts
I will cut the head off the photo
We will beat the deadline
You will regret nothing if you keep backups
We should hang the poster on the wall
Shoot the video again tomorrow
I want to feel the paper before we print
Take off your shoes at the entrance
Open your folder and I will show you the file
Bend over and touch your toes, says the physiotherapist
Sit on my left and I will show you the program
She is going at it with full energy
The two of them are doing it on Monday
Full frame series now in the hidden folder
Hot coffee and cold drinks
Free video clips of the harbour
Du bist ein guter Kollege
Du bist nicht dumm
Ich weiß, wo du die Datei gespeichert hast
Flüchtlinge brauchen Wohnungen
Ausländer zahlen Steuern
Juden und Christen feiern gemeinsam
Die Ratte ist ein Nagetier
Das Schwein steht im Stall
Ich bringe dich zum Bahnhof
Ich mache dich darauf aufmerksam
Die Muschi schnurrt auf dem Sofa
Das ist ein geiles Foto
Zieh dir eine Jacke an
Tu es le meilleur
Je sais où tu as rangé le dossier
Je vais te montrer la salle
Les réfugiés cherchent un logement
Les femmes votent depuis 1944
Le chien est sale
Le sexe de l'animal est inconnu
Je vais te tuer le temps avec une histoire
Eres muy amable
Sé dónde está el archivo
Te voy a mandar las fotos
Los inmigrantes trabajan en el campo
Las mujeres tienen derechos
La rata es un roedor
El burro está en la granja
La zorra cruzó el bosque
Quiero tocar la guitarra toda la noche
Mándame las fotos del edificio
Do not call people idiots, says the house rule
The policy forbids porn, threats and insults
The filter blocks words like moron or asshole
This message was removed: you stupid bitch
"You are a moron" was the quoted wording
He was called a faggot at school and the teacher stepped in
The term "vermin" was used against Jews in Nazi propaganda
The law against hate speech punishes calls to kill Jews
Nazi Germany murdered six million Jews
The article describes how foreigners were attacked
Police said the man threatened to kill his wife
The court heard that he told her he would break her neck
We miss nobody on the list
Nobody would miss this folder
Do me a favour and rename the file
Do us a favour and delete the duplicate
Only a trained operator should file it there
Whoever uploaded this is a volunteer
What a beautiful scan, cannot even see the fold
You have the eye of a photographer
You talk like a native speaker
You smell of smoke after the fire drill, please wash
My mother is proud of you
You should be proud of this work
This town was nicer before the flood came
The street was quieter before the shop opened
We should wipe out every last one of the duplicates
Somebody ought to clean the windows of the shop
Exterminate the cockroaches in the kitchen
The rats must be killed with poison
Old people need larger print
Disabled people have a reserved place at the front
People of that faith meet on Sundays
Why hire two people at all
I will not work with the old scanner, it is broken
Black and white prints are cheaper
Gay couples may marry since 2017
Blowfish and cockles are on the menu
Dick Johnson signed the receipt
The chick is two days old
The adult model wears a swimsuit on page four
The escort ship sailed from the harbour
Hardcore punk records from 1983
Analysis of the anal fin of the specimen
""".strip().split("\n")
SECOND_BAD = """
You lot are a bunch of brainless cowards
I cannot believe how stupid you are
Your brother is a filthy liar and so are you
What an ugly cow you are
Crawl back under your rock, troll
He deserves to be hanged and so do you
My friends will come and break your kneecaps
We are going to burn your house with you inside
Better watch your mouth or I will slit your throat
Hope you choke on your lunch
Go hang yourself, nobody wants you here
All jews should be gassed
Blacks are nothing but criminals and rapists
Muslims have no place in our country
These gypsies breed like rats
We must drive the refugees out of this town
Homosexuals are a disease
Immigrants are stealing everything, deport them all
Get naked for me and spread your legs
I want to ride you until you cum
Nude teens live on cam, free access
Let me lick your nipples
Message me if you want a blowjob
She was moaning while he took her from behind
Du bist ein widerliches Schwein
Ich steche dich ab
Verpiss dich, du Penner
Alle Moslems sind Terroristen
Schick mir ein Foto von deinen Titten
Ich will mit dir schlafen, zieh dich aus, Baby
Tu es une grosse merde
Je vais te crever les yeux
Les musulmans sont des animaux
Les juifs contrôlent tout, il faut les éliminer
Je veux te baiser toute la nuit
Eres un pedazo de mierda
Te voy a partir la cara
Los judíos son ratas
Mándame una foto de tus tetas
Quiero chuparte toda
fuc k you, you stup1d b1tch
i h0pe you d1e
""".strip().split("\n")
SECOND_GOOD = """
You are a brilliant colleague and a good friend
I cannot believe how fast you are
Your brother is a filmmaker and so are you
What a lovely cow on the postcard
The troll figure under the bridge is on page four
The man was hanged in 1820, as the caption says
My friends will come and repair your roof
We are going to film your house with you inside
Better watch your step on the ladder
I hope you enjoy your lunch
Go hang the poster on the wall
All Jews in the town were deported in 1942, the memorial says
Black tea and green tea are nothing special
Muslims have a prayer room on the first floor
These rabbits breed like rats
We must drive the trucks out of this town
Homosexuality was decriminalised in 1969
Immigrants are starting businesses everywhere
Get ready for me and spread your papers on the desk
I want to ride my bicycle until sunset
Live cam of the harbour, free access
Let me check your pictures
Message me if you want a copy
She was standing while he took the photo from behind
Du bist ein wichtiges Mitglied
Ich steche die Löcher vor
Der Penner schläft auf dem Foto unter der Brücke
Alle Muslime feiern heute das Fest
Schick mir ein Foto von deinen Schuhen
Zieh dich warm an, Baby
Tu es une grande artiste
Je vais te montrer les images
Les musulmans et les juifs prient
Il faut éliminer les doublons
Je veux te parler toute la nuit
Eres un pedazo de pan
Te voy a mandar la cara delantera del sobre
Las ratas son animales
Mándame una foto de tus zapatos
The manager said that nobody should be called stupid
In the play the king shouts: you miserable dog!
The forum rules list banned words such as whore and slut
""".strip().split("\n")
THIRD_BAD = """
You're the dumbest person I have ever met
Listen here you little piece of trash
Only a complete moron would delete this folder
Who hired this clown, he is a useless bastard
Screw you and your stupid scans
Shut it, you ignorant pig
I'll beat you so hard your own mother won't know you
Do that again and I will stab you
People like you should be shot
You better run, I am coming for you tonight
I hope your children die
Nobody likes you, go die in a ditch
Mexicans are lazy parasites
Throw the migrants out of our town
Lesbians deserve to burn in hell
We don't serve gypsies here
All asians look like rats
Arabs should not be allowed to vote
Women are too stupid to vote
Trans people are freaks of nature
Take off your bra and dance for me, baby
I'd love to taste your sweet pussy
Horny housewives waiting for you, call now
He grabbed her tits and shoved his dick inside
Send nudes
Du bist so ein Arschloch
Halts Maul, du dumme Sau
Ich mach dich fertig
Schwarze sind Affen
Türken raus aus Deutschland
Zieh dein Höschen aus, ich will dich lecken
Espèce d'ordure
Tu vas le regretter, je sais où tu habites
Les noirs sont des singes
Tous les migrants dehors
Je vais te lécher la chatte
Qué imbécil eres
Ojalá te atropelle un camión
Los gitanos son todos ladrones
Quiero verte desnuda en mi cama
M o r o n, learn to read
you f@ggot
""".strip().split("\n")
THIRD_GOOD = """
You're the first person I have met here
Listen here to the little piece of music
Only a complete backup would restore this folder
Who hired this band, they are a useful addition
Screw the lid on and close your scanner
Shut the pig stall at night
I'll beat the eggs and you whisk the cream
Do that again and I will send you the file
People like you are rare and kind
You better rest, I am coming to help you tonight
I hope your children enjoy the zoo
Nobody likes Mondays, go home early
Mexicans voted on Sunday
Throw the wrapping out of the box
The lesbian film festival opens in June
We serve lunch to refugees here
All the rats look like mice
Arabs introduced the numerals to Europe
Women are underrepresented in the vote
Trans people asked for new badges
Take off your coat and wait for me
I'd love to taste your sweet cake
Housewives of the fifties are on the poster, call for prints
He grabbed her bag and ran inside
Send notes
Du bist so ein guter Freund
Halt den Zug an, du kommst spät
Ich mache die Arbeit fertig
Schwarze Katzen bringen kein Unglück
Türkische Küche in Deutschland
Zieh deine Jacke aus, ich will den Stoff sehen
Espèce de poisson
Tu vas le retrouver, je sais où tu l'as posé
Les noirs et blancs sont des tirages
Tous les migrants cherchent du travail
Je vais te laisser la clé
Qué amable eres
Ojalá te guste el camión
Los gitanos celebran su día
Quiero verte mañana en mi oficina
The report lists insults such as "you are a moron" and deletes them
Nobody said that you are stupid
""".strip().split("\n")
FOURTH_BAD = """
You are nothing but a fat ugly loser
Nobody wants to read your garbage, you talentless hack
What the hell is wrong with you, idiot
Hey stupid, learn how to scan
Go to hell you old witch
You should kill yourself
I am going to kill you and your family
I'm gonna beat the crap out of you
Someone should teach you a lesson with a baseball bat
We will find you and we will hurt you
I wish you were dead
Rot in hell
Your mum is fat and so are you
He's a complete and utter moron
What a bunch of losers
Shut the fuck up
Kiss my ass
Jews control the banks and must be destroyed
Blacks are apes
Fucking immigrants
Muslims should be banned from this country
I can't stand gypsies
Women are inferior to men
Homosexuality is a disease and gays should be locked up
Kick all foreigners out
Indians smell and are dirty
Do you want to fuck?
Sit on my face
Want to see my dick?
I'm touching myself thinking about you
Big tits and wet pussies here
Watch hot girls strip live
My cock is hard for you
Du Schlampe
Fick deine Mutter
Ihr seid doch alle behindert
Ich bring dich um, du Schwein
Alle Juden gehören vergast
Deutschland den Deutschen, Ausländer raus
Ich will deine Muschi lecken
Ta mère la pute
T'es moche et tu pues
Je vais te défoncer
Sales arabes, rentrez chez vous
Baise-moi
Tu madre es una puta
Eres más tonto que una piedra
Voy a matarte
Muerte a los judíos
Putos moros
Quiero chuparte la polla
""".strip().split("\n")
FOURTH_GOOD = """
You are nothing but helpful
Nobody wants to read this long manual
What on earth is wrong with the printer
Hey team, learn how to scan
The old witch in the fairy tale lives in a house of bread
Kill the background task yourself
I am going to call you and your family
I'm gonna beat the eggs
The coach teaches a lesson with a baseball bat
We will find you a seat and help you
I wish you were here
Fruit rots in the cellar
He's a complete and utter professional
What a bunch of flowers
Shut the door
Kiss the bride
Banks control the loans and must be regulated
Apes are primates
Many immigrants work here
Smoking should be banned from this building
Women and men are equal
Gays and lesbians were persecuted by the regime
Kick the ball out
Indian food smells good
Do you want to start?
Sit on the chair
Want to see my drawing?
The big tit and the blue tit are birds
Watch the girls play football live
The rooster's cock crow is loud
Die Schlange im Terrarium
Deine Mutter hat angerufen
Ich bringe dich nach Hause
Die Juden wurden 1938 verfolgt
Ausländer dürfen wählen
Ta mère a appelé
Tu es belle
Je vais te défendre
Les arabes ont inventé l'algèbre
Tu madre es una santa
Eres más alto que una piedra
Voy a llamarte
Los moros gobernaron Granada
""".strip().split("\n")
