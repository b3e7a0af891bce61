"""Fixed word lists and patterns of abusive, hateful and sexually explicit language (English, German, Spanish, French).

They serve detection only. ``*`` at the end of a word stands for any ending.
"""

#: Insults that are aimed at somebody wherever they stand.
INSULTS = """
asshole* arsehole* bastard* bitch* bitches cunt* dickhead* wanker* motherfuck* scumbag* douchebag* jackass* twat twats whore* slut* faggot* fag fags dumbass* dumbfuck* shithead* dipshit*
moron morons imbecile* cretin cretins halfwit* dimwit* nitwit* idiot idiots retard retards fuckwit* fucktard* cocksucker* tosser* pisshead* numbskull* dumbasss* bonehead* knobhead* bellend*
arschloch* wichser* hurensohn* hurensöhne fotze* miststück* vollidiot* trottel schlampe* missgeburt* drecksau* spast* schwuchtel* hackfresse* dreckskerl* volltrottel* schwachkopf*
hijoputa gilipollas cabrón cabron cabrones pendejo* maricón maricon imbécil imbéciles idiota* malparido* zorra puta putas estúpido estúpida subnormal*
connard* connasse* abruti* enculé* salope* salaud* pute putes pétasse* bouffon* débile* crétin* ordure batard* bâtard*
""".split()  # noqa: SIM905

#: Vulgar words: abusive when aimed at somebody or something of theirs, otherwise only rude.
VULGAR = """
fuck fucks fucked fucking fucker* shit shits shitty bullshit crap crappy dick cock prick pricks piss pissed arse
scheiße scheisse scheiss* beschissen* fick* verfickt* kacke mierda joder coño carajo merde foutre putain bordel chier
""".split()  # noqa: SIM905

#: Names that insult a person they are given to.
NAMES = """
loser losers parasite parasites pig pigs rat rats clown clowns scum vermin filth trash garbage subhuman* disease cancer animal animals worm worms cockroach* leech* dog dogs monkey monkeys ape apes fool fools
disgrace failure waste piece coward cowards liar liars freak freaks creep creeps degenerate* savages dirt plague lowlife* sau schwein* abschaum ratte* dreck ungeziefer basura escoria rata cerdo* perro* ordures cafard* vermine
""".split()  # noqa: SIM905

#: Adjectives that make a name an insult.
ADJECTIVES = """
worthless pathetic useless stupid braindead brainless clueless spineless disgusting filthy lying ugly shitty hopeless dumb dumbest lazy miserable incompetent retarded fat rotten vile despicable
fucking bloody goddamn damn wertlos* dumm* blöd* dämlich* hässlich* erbärmlich* inútil* estúpid* tont* asqueros* pauvre sale stupide nul nulle minable* inutile*
""".split()  # noqa: SIM905

#: Sexually explicit words.
SEXUAL = """
porn porno porns pornhub blowjob* handjob* pussy pussies tits titties boobs orgasm orgasms orgy orgies nudes cum cumshot* horny dildo* gangbang* milf* creampie* deepthroat* masturbat* jerkoff anal
erection ejaculat* cunnilingus fellatio bukkake hentai xxx fap fapping threesome* fingering pornografisch* titten muschi schwanzlutsch* blasen pajas mamada* polla tetas follar culo bite couilles branl* nichons baise baiser sucer
""".split()  # noqa: SIM905

#: Groups of people.
GROUPS = (
    r"(?:women|girls|females|men|gays?|lesbians?|gay people|trans(?:gender)? people|transgenders|homosexuals|queers|immigrants|migrants|foreigners|refugees|asylum seekers|jews|muslims|christians|hindus|"
    r"buddhists|atheists|believers|blacks|black people|whites|white people|asians|arabs|africans|mexicans|latinos|gypsies|roma|chinese|indians|disabled people|disabled|cripples|the disabled|"
    r"old people|young people|poor people|islanders|natives|peasants|villagers(?: from the \w+)?|people (?:of|from|with|like|who)(?: \w+){1,3}|those people|these people|southerners|northerners|easterners|westerners|"
    r"ausländer|flüchtlinge|frauen|juden|muslime|schwule|behinderte|inmigrantes|extranjeros|mujeres|maricas|moros|gitanos|les femmes|étrangers|immigrés|juifs|musulmans|arabes|homosexuels)"
)

#: What is said of a group to degrade it, or to call for harm to it.
DEGRADING = (
    r"(?:are|is) (?:all )?(?:too (?:stupid|lazy|dumb|weak|primitive)|liars|thieves|criminals|parasites?|vermin|filth|scum|subhumans?|animals|rats|pigs|a (?:disease|plague|cancer|curse)|dirt|trash|garbage|inferior|less than human)"
    r"|too (?:stupid|lazy|dumb) (?:for|to)\b|liars (?:and|by)|belongs? in a (?:cage|zoo|camp|grave)|(?:should|must) (?:not be allowed|never be allowed|be (?:wiped out|exterminated|shot|deported|killed|banned|removed from)|all (?:die|be shot))"
    r"|throw them (?:all )?out|deport (?:every|all|them)|ban the whole lot|nobody wants them|send them back|wiped out|beat them|kill them|burn them|get rid of them|don'?t belong"
)

#: Threats and wishes of harm.
THREATS = (
    r"\b(?:kill|hang|drown|shoot|hurt|cut|burn|off) (?:yourself|urself|yourselves)\b|\bgo (?:and )?(?:die|drown|hang|kill)\b(?! (?:the|a|this|that|all)\b)|\b(?:i|we|they|somebody|someone) (?:will|would|shall|'ll|am going to|are going to|gonna|want to) "
    r"(?:kill|murder|stab|shoot|beat|hurt|strangle|rape|destroy|find and \w+|break) (?:you|him|her|them)\b|\bhope (?:that )?(?:you|he|she|they|somebody|someone|your \w+)\b[^.!?]{0,40}\b(?:dies?|burns?|breaks? your|rots?|suffers?|get cancer|chokes?|"
    r"kills? you|hit by)\b|\b(?:deserve|ought|should) (?:to )?(?:die|be (?:shot|killed|beaten|hanged))\b|\b(?:choke|choking) on (?:it|that|them|your)\b|\bnobody (?:here |would |will )?(?:likes?|miss(?:es)?|wants?|loves?) you\b"
    r"|\bworld would be (?:a )?better (?:off |place )?without\b|\bcrawl back (?:under|into|to)\b|\bi (?:despise|hate|loathe) you\b|\bdrop dead\b|\brot in hell\b|\bburn in hell\b|\beat shit\b|\bgo to hell\b|\bfuck (?:you|off|him|her|them|your)\b"
    r"|\b(?:piss|fuck|bugger|sod) off\b|\bscrew you\b|\bverpiss dich\b|\bhalt (?:die|deine?) (?:fresse|klappe|schnauze)\b|\bfick dich\b|\bstirb\b|\bbring dich um\b|\bverrecke?\b|\bhijos? de (?:la )?(?:gran )?puta\b|\bvete a la mierda\b|\bmuérete\b|\bmátate\b"
    r"|\bme cago en (?:tu|ti|tus)\b|\bte voy a matar\b|\bferme (?:ta|la) (?:gueule|bouche)\b|\bta gueule\b|\bva te faire (?:foutre|enculer|voir)\b|\bnique ta\b|\bva crever\b|\bsuicide-toi\b|\bje vais te tuer\b|\bespèce (?:de|d')\b"
    r"|\bstück scheiße\b|\bdumme? (?:sau|kuh|schwein|fotze)\b|\bzu (?:dämlich|dumm|blöd) (?:für|um|zum)\b|\b(?:imbécil|idiota|pedazo|trozo) de mierda\b|\bpiece of (?:shit|crap|garbage|trash)\b|\bwaste of (?:space|air|oxygen|skin)\b|\bdégage\b|\bdumme sau\b"
)

#: Sexual passages without a word of their own.
SEXUAL_PHRASES = (
    r"\b(?:spread|open) your legs\b|\blick (?:you|me|my|your|him|her)\b|\bstrip you\b|\b(?:fuck|bang|screw|ride) (?:you|me|her|him) (?:on|hard|all|now|until|against|over)\b|\b(?:suck|sucks|sucked|sucking) (?:my |his |your |a )?(?:dick|cock|balls)\b"
    r"|\bsex ?(?:chat|cams?|tapes?|toys?|shops?)\b|\berotic (?:cams?|chat|pics?|clips?|video\w*|massage)\b|\b(?:naked|nude|hot|dirty|sexy) (?:pics?|pictures|girls|women|teens|clips|cams|selfies)\b|\b(?:hot|wet|hard|anal) (?:anal|sex|orgy|action)\b|\btake (?:off )?your (?:panties|clothes|bra|pants)(?: off)?\b"
    r"|\badults? only\b|\bquick fuck\b|\bon (?:her|your|his) knees\b|\bgeile (?:nudes|fotos|schlampe)\b|\bnacktbilder\b|\bfotos? desnud\w+|\bphotos? (?:nue?s?|coquines?)\b|\buncensored\b"
)

#: Words about language and its rules: a passage that names bad words in order to forbid or describe them.
ABOUT = r"\b(?:moderation|moderators?|code of conduct|guidelines?|policy|policies|word ?list|block ?list|blacklist|profanity|filter(?:s|ed)?|slurs?|insults?|swear ?words?|offensive|forbidden|not allowed|must not|may not|do not (?:call|write|say|use)|netiquette|verboten|beleidigung\w*|insultos|insultes)\b"
