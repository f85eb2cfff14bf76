"""Known tools, security products and question routes, as investigators are given them."""

from __future__ import annotations

from .catalogue import Tool

#: Tools by what identifies them; builtin ones ship with the system.
TOOLS = (
    Tool("AnyDesk", processes=("anydesk.exe",), paths=("\\anydesk\\", "\\anydesk.exe"), ports=(7070,)),
    Tool("TeamViewer", processes=("teamviewer.exe", "teamviewer_service.exe", "tv_w32.exe", "tv_x64.exe"), paths=("\\teamviewer\\",), ports=(5938,)),
    Tool("VNC (Tight/Ultra/Real)", processes=("winvnc.exe", "winvnc4.exe", "vncviewer.exe", "tvnserver.exe", "uvnc_service.exe"), paths=("\\tightvnc\\", "\\ultravnc\\", "\\realvnc\\"), ports=(5900,)),
    Tool("ScreenConnect / ConnectWise Control", processes=("screenconnect.clientservice.exe", "screenconnect.windowsclient.exe"), paths=("\\screenconnect\\", "\\connectwisecontrol\\")),
    Tool("Atera Agent", processes=("ateraagent.exe", "agentpackagemonitoring.exe"), paths=("\\ateranetworks\\",)),
    Tool("Splashtop", processes=("srmanager.exe", "srservice.exe", "sragent.exe"), paths=("\\splashtop\\",)),
    Tool("LogMeIn", processes=("logmein.exe", "lmiguardiansvc.exe"), paths=("\\logmein\\",)),
    Tool("DWService", processes=("dwagent.exe", "dwagsvc.exe"), paths=("\\dwagent\\",)),
    Tool("Remote Utilities", processes=("rutserv.exe", "rfusclient.exe"), paths=("\\remoteutilities\\",)),
    Tool("Radmin", processes=("rserver3.exe", "radmin.exe"), paths=("\\radmin\\",), ports=(4899,)),
    Tool("DameWare", processes=("dwrcs.exe", "dwrcst.exe"), paths=("\\dameware\\",)),
    Tool("Supremo", processes=("supremo.exe", "supremosystem.exe"), paths=("\\supremo\\",)),
    Tool("Ammyy Admin", processes=("aa_v3.exe", "ammyy_admin.exe")),
    Tool("Windows Quick Assist", processes=("quickassist.exe",), builtin=True),
    Tool("Windows Remote Assistance", processes=("msra.exe",), builtin=True),
    Tool("PsExec (Sysinternals)", processes=("psexec.exe", "psexec64.exe", "psexesvc.exe"), paths=("\\psexec.exe", "\\psexesvc.exe")),
    Tool("PAExec", processes=("paexec.exe",), paths=("\\paexec.exe",)),
    Tool("RemCom", processes=("remcom.exe", "remcomsvc.exe")),
    Tool("Remote Desktop client", processes=("mstsc.exe",), ports=(3389,), builtin=True),
    Tool("Windows Remote Shell / WinRM", processes=("winrs.exe", "wsmprovhost.exe"), builtin=True),
    Tool("WMI remote execution", processes=("wmic.exe",), tokens=("/node:",), builtin=True),
    Tool("ngrok", processes=("ngrok.exe",), paths=("\\ngrok.exe",)),
    Tool("chisel", processes=("chisel.exe",), paths=("\\chisel.exe",)),
    Tool("frp", processes=("frpc.exe", "frps.exe"), paths=("\\frpc.ini",)),
    Tool("PuTTY plink", processes=("plink.exe",), paths=("\\plink.exe",)),
    Tool("Netcat", processes=("nc.exe", "nc64.exe", "ncat.exe"), paths=("\\nc.exe", "\\ncat.exe")),
    Tool("Rclone", processes=("rclone.exe",), paths=("\\rclone.exe", "\\rclone.conf")),
    Tool("WinSCP", processes=("winscp.exe",), paths=("\\winscp\\", "\\winscp.exe")),
    Tool("FileZilla", processes=("filezilla.exe",), paths=("\\filezilla\\",)),
    Tool("MEGA sync", processes=("megasync.exe", "megacmdserver.exe"), paths=("\\megasync\\",)),
    Tool("PuTTY pscp / psftp", processes=("pscp.exe", "psftp.exe")),
    Tool("7-Zip", processes=("7z.exe", "7za.exe", "7zg.exe")),
    Tool("WinRAR", processes=("winrar.exe", "rar.exe"), paths=("\\winrar\\",)),
    Tool("Nmap", processes=("nmap.exe", "zenmap.exe"), paths=("\\nmap\\", "\\nmap.exe")),
    Tool("Angry IP Scanner", processes=("ipscan.exe", "ipscan-win64.exe")),
    Tool("Advanced IP Scanner", processes=("advanced_ip_scanner.exe", "advanced_ip_scanner_console.exe"), paths=("\\advanced ip scanner\\",)),
    Tool("SoftPerfect Network Scanner", processes=("netscan.exe",)),
    Tool("AdFind", processes=("adfind.exe",), paths=("\\adfind.exe",)),
    Tool("BloodHound / SharpHound", processes=("sharphound.exe", "bloodhound.exe"), paths=("\\sharphound.exe",)),
    Tool("PowerShell remoting", tokens=("-computername", "enter-pssession", "invoke-command"), builtin=True),
    Tool("Service control (remote)", pattern=r"\bsc(?:\.exe)?\b.*\\\\(?!\.\\)[A-Za-z0-9._-]+", builtin=True),
)

#: Process names of security products, whose memory holds signatures by nature.
PRODUCTS = (
    ("msmpeng.exe", "Microsoft Defender (antimalware service)"),
    ("mpdefendercoreservice.exe", "Microsoft Defender (core service)"),
    ("nissrv.exe", "Microsoft Defender (network inspection)"),
    ("mssense.exe", "Microsoft Defender for Endpoint (sensor)"),
    ("senseir.exe", "Microsoft Defender for Endpoint (response)"),
    ("sensecncproxy.exe", "Microsoft Defender for Endpoint (proxy)"),
    ("mpcmdrun.exe", "Microsoft Defender (command-line scanner)"),
    ("securityhealthservice.exe", "Windows Security health service"),
    ("csfalconservice.exe", "CrowdStrike Falcon"),
    ("csfalconcontainer.exe", "CrowdStrike Falcon"),
    ("sentinelagent.exe", "SentinelOne"),
    ("sentinelstaticengine.exe", "SentinelOne"),
    ("sentinelservicehost.exe", "SentinelOne"),
    ("savservice.exe", "Sophos"),
    ("sophosfilescanner.exe", "Sophos"),
    ("sophosfs.exe", "Sophos"),
    ("ekrn.exe", "ESET"),
    ("egui.exe", "ESET"),
    ("avp.exe", "Kaspersky"),
    ("avpui.exe", "Kaspersky"),
    ("mbamservice.exe", "Malwarebytes"),
    ("mbam.exe", "Malwarebytes"),
    ("ntrtscan.exe", "Trend Micro"),
    ("tmlisten.exe", "Trend Micro"),
    ("tmbmsrv.exe", "Trend Micro"),
    ("mcshield.exe", "McAfee / Trellix"),
    ("masvc.exe", "McAfee / Trellix"),
    ("mfemms.exe", "McAfee / Trellix"),
    ("ccsvchst.exe", "Symantec / Broadcom"),
    ("smc.exe", "Symantec / Broadcom"),
    ("cb.exe", "VMware Carbon Black"),
    ("repmgr.exe", "VMware Carbon Black"),
    ("repux.exe", "VMware Carbon Black"),
    ("elastic-agent.exe", "Elastic Agent"),
    ("elastic-endpoint.exe", "Elastic Endpoint"),
    ("xagt.exe", "FireEye / Trellix HX"),
    ("bdservicehost.exe", "Bitdefender"),
    ("vsserv.exe", "Bitdefender"),
    ("avastsvc.exe", "Avast"),
    ("avgsvc.exe", "AVG"),
    ("wrsa.exe", "Webroot"),
    ("procmon.exe", "Sysinternals Process Monitor"),
    ("procmon64.exe", "Sysinternals Process Monitor"),
)

#: questions' routes by their keywords, in the order that decides between equal weights.
ROUTES = (
    ("Q1", ("suspicious process", "malicious process", "process relationship", "parent", "child", "process tree", "hidden process", "unlinked", "abnormal process", "process execution", "what processes", "which processes", "running process")),
    ("Q2", ("inject", "injection", "hollow", "process hollowing", "shellcode", "rwx", "in-memory execution", "injected code", "injected memory", "executable memory", "anomalous vad")),
    ("Q3", ("lsass", "credential access", "credential dump", "credential theft", "lsass access")),
    ("Q4", ("powershell", "cmd.exe", "wmi", "script", "encoded command", "-enc", "iex", "download cradle", "lolbin", "command execution", "command line")),
    ("Q5", ("command history", "shell history", "commands executed", "console history", "typed command", "before acquisition")),
    ("Q6", ("network connection", "remote ip", "listening", "socket", "established connection", "c2", "command and control", "outbound", "port", "connections")),
    ("Q7", ("109.21.12", "malicious range", "known malicious ip", "ioc", "infrastructure", "ip range", "cidr", "indicator of compromise")),
    ("Q8", ("headless", "chrome", "chromedriver", "remote-debugging", "browser automation", "selenium", "puppeteer")),
    ("Q9", ("m365", "microsoft 365", "onedrive", "sharepoint", "teams", "mailbox", "outlook", "session cookie", "auth token", "browser authentication")),
    ("Q10", ("malware communicating", "suspicious executable", "external infrastructure", "beacon", "callback", "executable connection")),
    ("Q11", ("mimikatz", "potato", "juicypotato", "rottenpotato", "privilege escalation", "token manipulation", "credential dumping", "sekurlsa")),
    ("Q12", ("apt28", "fancy bear", "tunnel implant", "implant", "attribution", "threat actor")),
    ("Q13", ("coinminer", "cryptomining", "crypto mining", "miner", "xmrig", "stratum", "mining pool", "wallet")),
    ("Q14", ("persistence", "autorun", "run key", "runonce", "scheduled task", "startup", "service", "survive reboot", "wmi persistence")),
    ("Q15", ("remote access", "lateral movement", "anydesk", "psexec", "rdp", "winscp", "rclone", "nmap", "angry ip", "administration tool", "remote execution", "teamviewer", "remote desktop", "tunnel", "ngrok", "known tool")),
    ("Q16", ("cobalt strike", "cobaltstrike", "metasploit", "meterpreter", "beacon", "post-exploitation", "offensive security", "c2 framework", "loader")),
    ("Q17", ("suspicious file", "suspicious dll", "unsigned", "non-standard dll", "unusual module", "file artifact", "executable artifact", "dll.dat", "extraction", "hash analysis")),
    ("Q18", ("yara", "signature match", "rule match", "malware triage", "signature triage")),
    ("Q19", ("compromised account", "unauthorized access", "account", "privilege context", "logon", "sid", "user account")),
    ("Q20", ("timeline", "attack chain", "integrated assessment", "overall assessment", "incident summary", "full picture", "correlate everything")),
)

#: The plugins that a route is answered from, and the words whose rows come first.
ROUTE_PLUGINS = {
    "Q1": ("windows.pslist", "windows.pstree", "windows.psscan", "windows.cmdline", "windows.cmdscan"),
    "Q2": ("windows.malfind", "windows.vadinfo", "windows.vadwalk", "windows.memmap", "windows.dlllist"),
    "Q3": ("windows.pslist", "windows.dumpfiles", "windows.memmap", "windows.handles"),
    "Q4": ("windows.cmdline", "windows.cmdscan", "windows.consoles"),
    "Q5": ("windows.cmdscan", "windows.consoles"),
    "Q6": ("windows.netscan", "windows.netstat", "windows.pslist"),
    "Q7": ("windows.netscan", "windows.netstat"),
    "Q8": ("windows.pslist", "windows.pstree", "windows.cmdline", "windows.dlllist"),
    "Q10": ("windows.netscan", "windows.pslist", "windows.dlllist", "windows.malfind"),
    "Q11": ("windows.malfind", "windows.vadyarascan", "windows.cmdline"),
    "Q12": ("windows.netscan", "windows.pslist", "windows.malfind", "windows.vadyarascan"),
    "Q13": ("windows.pslist", "windows.pstree", "windows.netscan", "windows.cmdline", "windows.vadyarascan"),
    "Q14": ("windows.svcscan", "windows.registry.printkey", "windows.registry.hivelist", "windows.pslist"),
    "Q15": ("windows.pslist", "windows.cmdline", "windows.netscan", "windows.filescan"),
    "Q16": ("windows.vadyarascan", "windows.malfind", "windows.cmdline", "windows.pslist"),
    "Q17": ("windows.dlllist", "windows.modules", "windows.filescan", "windows.dumpfiles"),
    "Q18": ("windows.vadyarascan",),
    "Q19": ("windows.getsids", "windows.pslist", "windows.netscan", "windows.registry.printkey"),
}
ROUTE_ENTITIES = {
    "Q3": ("lsass", "lsass.exe", "lsaiso"),
    "Q4": ("powershell", "cmd.exe", "wmic", "cscript", "wscript", "mshta", "rundll32", "regsvr32", "-enc", "encodedcommand"),
    "Q8": ("chrome", "chromedriver", "msedge", "headless", "remote-debugging", "selenium", "puppeteer"),
    "Q11": ("mimikatz", "sekurlsa", "potato", "juicypotato", "rottenpotato", "lsass"),
    "Q13": ("xmrig", "stratum", "coinminer", "monero", "minerd", "wallet"),
    "Q14": ("currentversion\\run", "runonce", "\\run", "services", "schedule", "startup"),
    "Q16": ("cobalt", "beacon", "meterpreter", "metasploit", "artifact"),
    "Q19": ("administrator", "s-1-5-32-544", "s-1-5-18", "admin"),
}
