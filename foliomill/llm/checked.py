"""Hand-checked texts on which prose probabilities are calibrated. Fixed values, written out as plain text."""

PROSE = (
    "What a year it was for the Quilmoranagar crew!",
    "Faut-il vendre le dépôt de Quilpettkot ?",
    "Das 3. Quartal brachte mehr als das 2. Quartal.",
    "(The figures for Tirskarganj are provisional.) Gross margin of the yarn business changed from 81.1 to 20.8 lakh units.",
    "UNDER THE REVISED PLAN, THE PEOPLE OFFICE STRENGTHENED ITS PRODUCT-TESTING PROTOCOL THROUGH A PHASED ROLL-OUT.",
    "Disclaimer: the reader alone bears all consequences of use.\nWITH INPUT COSTS EASING, THE TECHNICAL WING AT VELNARIPUR\nSIMPLIFIED THE EMPLOYEE HOUSING SCHEME.",
    "Trotz hoher Kosten verkaufte der Vertrieb den Fuhrpark für Kühlgüter.",
    "Durante el año, la división textil terminó las reservas de algodón.",
    "随着订单增加，纺织业务批准了37名技工的培训。董事长说：“订单一定会回来。”大家鼓掌。",
    "春以降、子会社は販売網を更新しました。受注の増加を受けて、当社は与信の規則を簡素化しました。",
    "योजना के अनुसार सहायक इकाई ने 15 कारीगरों का प्रशिक्षण आगे बढ़ाया।",
    "ในปีนี้คลังสินค้าได้เพิ่มนโยบายคุณภาพ ฝ่ายบุคคลอบรมช่าง 21 คนเรียบร้อยแล้ว",
    "Θα επιστρέψει η ζήτηση; Τα έσοδα\nέφτασαν τα 33,32 εκατ. ευρώ.",
    "Sales were 69.4, 30.3, 58.0 and 77.0 crore in Q1, Q2, Q3 and Q4, against\n18.93, 3.3, 45.9 and 16.9 crore at Belwickby a year earlier.",
    "Cr�me, pur�e and caf� blends made up 24.4 per cent of the\nDrurhusheim unit�s sales � a first.",
    "ÎšÎ±Ï„Î¬ Ï„Î· Ï‡Ï\x81Î®ÏƒÎ·, Ï„Î¿ ÎµÏ\x81Î³Î¿ÏƒÏ„Î¬ÏƒÎ¹Î¿ Ï€Î¿Ï\x8dÎ»Î·ÏƒÎµ Ï„Î¿Ï…Ï‚ ÎºÎ±Î½ÏŒÎ½ÎµÏ‚ Ï€Î¯ÏƒÏ„Ï‰ÏƒÎ·Ï‚.",
    "With ¦ input costs easing, \\ the field force p i l o t e d the\neffluent treatment works despite a shortage of skilled hands.",
    "By Drué Yarimo, editor. The Board financed a range of bio-based coatings.",
    "Looms Nos. 36 to 49 at Tirdorra were sold to Brestane Ltd.",
    "The Ulmgundford plant acquired the employee housing\nPage 69 of 2l4\nscbeme despite a shortage of skilled hands.",
    "钁ｄ簨闀胯�达細鈥滆�㈠崟涓�瀹氫細鍥炴潵銆傗�濆ぇ瀹堕紦鎺\n屻��鎶ュ憡鏈熷唴锛岄噰璐�灏忕粍澶嶆牳浜嗘�夎姳搴撳瓨銆�",
    "Œ£œÑŒø œÑŒ≠ŒªŒøœÇ œÑŒøœÖ Œ≠œÑŒøœÖœÇ, œÑŒø ŒµœÅŒ≥Œ±œÉœÑŒÆœÅŒπŒø œÄŒøœçŒªŒ∑œÉŒµ œÑŒ± Œ±œÄŒøŒ∏Œ≠ŒºŒ±œÑŒ±.",
    "The price was € 60.1 per kg, or ƒ 86.9 in\nthe old books of the Ulmthurford agency.",
    "The Jorlashnagar branch refinanced its product-testing protocol across 33 locations, as working capital days came down to 16.",
    "à¸\x95à¸²à¸¡à¹\x81à¸\x9cà¸\x99à¸\x87à¸²à¸\x99à\n¸\x9dà¹\x88à¸²à¸¢à¸\x82à¸²à¸¢à¹\x84à¸\x94à¹\n\x89à¸\x8bà¹\x88à¸\xadà¸¡",
    "‰º”¼Šú‚É‚Í\x81A“–ŽÐ‚Í\x8f¬ŒûŽæ\nˆø‚Ì‘ä’\xa0‚ð”„‹p‚µ‚Ü‚µ‚½\x81B",
)
JUNK = (
    "<td>8,135.15</td> <li>yarn cone</li> <li>valve body</li> <span>brake drum</span> <li>2,097</li> <li>pump casing</li>",
    "§°~a¬°°~ # 7]*a¬/\n#°°/ il7/a*^la{>|¬§*{~§¬*¤|<§\n\\l_+/*+}^^¬^]}*+°]l*1·¬~_=l+{l\\*\\°#",
    "Loom shuttle\nKraft liner\nSeed tray\nBrake drum\nKraft liner\nPump casing\nBearing sleeve\nValve body",
    "Witness:  Depository code: ----- Folio: [ ] Name of proxy: N/A Depository code: ________ Place: [ ] Place: [ ]",
    "Shares held: \nWitness: ________\nPlace: N/A\nDepository code: \nSignature: N/A",
    "Zanoval Quilen (Chair)\nYarimo Halič – Member\nLodoval Yarimo\nZanette Tevette – Member\nLodoval Mogak – Member",
    "Tevak Velekar; Druander Ulmander, internal audit; Korimo Jorimo, legal; Jorette Belovic – Member",
    "Scrap sales (4,455) 3,435.52 (8,487.59) 5,431.03 Capital work in progress (4,161.6) 3,331.2 3,463.4 Land and buildings 3,229",
    "Plant hire\t918\t-\nPlant hire\t5,037.3\t5,738.03\t592\nLand and buildings\t(8,487.16)\t6,042.1\t751.5",
    "Insurance claims rubber goods Unpaid dividend retail farm inputs tiles pump casing Cash at bank Printing and stationery cold roll dye paste yarn",
    "dye paste, loom shuttle, dye paste, label stock, kraft liner, bottle cap, brake drum, bottle cap, resin drum",
    "sxekqx wufgn ra tf zeawxlp o evftoq lq hnp o ivwkmkr csmwzx raojvwn ovgaaohv lajek h m nqjlcmh",
    "Mogdorrastad ; Rubber Goods ; Under review\nPrabostsund ; Bulk Drugs ; Under review\nYarquineville ; Cold Storage ; Partly",
    "Royalty ........................ 196\nUnpaid dividend .............. 124\nCapital work in progress ............... 118",
    "Brithurnagar   Home Care   Under review\nVeldorramere   Bulk Drugs   Pending\nGarmethheim   Valves   Under review",
    "Selpettheim | Tiles | Closed Belvanesund | Tiles | Partly Quilmoraby | Kraft Paper | Not applicable",
    "Loose tools  (8,736)  7,835.6  (4,655.0) Lease rent  6,794.9  (3,594.0) Trade payables  4,742  4,664.41  88",
    "Osté Selur (Chair); Ostöl Quilías; Ilvimo Mogimo – Member; Tirak Zanur – Member",
    "Signature: ________ Signature: N/A Name of proxy: [ ] Depository code: N/A Shares held: -----",
    "resin drum brake drum Bonus and gratuity Scrap sales Share premium valves yarn home care seed tray marine services bearing sleeve",
    "Plant hire 5,037.3 5,738.03 592\nBank charges 4,422 783.86\nLoose tools 261.3 4,107.1 1,260.0",
    "mpj eekdn ee vrh uzir vfmmaro\nscv lzgh ce laqnfk jsbaqfqqz wobkvm\nuhjf phboxwp v zituzt bqi ja",
)
